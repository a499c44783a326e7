"""Similarity matching of digests without comparing every file with every target.

Both joins work on distinct digests, so any number of copies counts once, and both compare two
digests only when they meet under a key that every match must share: nothing is lost.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from egresslens import constants as C
from egresslens.functions.digests import DIGEST_CHARS, WINDOW, indel_score
from egresslens.operators.skew import ROWS_PER_TASK, spread_hot_keys
from egresslens.session import materialize

_HEX_BODY = 64


# --- piecewise digests -------------------------------------------------------------------------

def _signatures(df: DataFrame, column: str) -> DataFrame:
    """``(digest, block, sig)``: both signatures of each distinct digest, long runs cut to three."""
    # anything else, signatures over 64 characters included, is no digest and gives no row
    pattern = r"^(\d+):([A-Za-z0-9+/]{0,64}):([A-Za-z0-9+/]{0,64})(?:,.*)?$"
    cut = lambda group: F.regexp_replace(
        F.regexp_extract(column, pattern, group), r"(.)\1{3,}", "$1$1$1")
    block = F.expr(f"try_cast(regexp_extract({column}, '^([0-9]+):', 1) AS bigint)")
    return df.select(column).dropna().distinct().filter(F.col(column).rlike(pattern)).select(
        F.col(column).alias("digest"), F.inline(F.array(
            F.struct(block.alias("block"), cut(2).alias("sig")),
            F.struct((block * 2).alias("block"), cut(3).alias("sig")))))


def _numbered(signatures: DataFrame) -> DataFrame:
    """Distinct signatures long enough to match, with a number that stands for each in the join; written once."""
    long = signatures.select("block", "sig").distinct().filter(F.length("sig") >= WINDOW)
    return materialize(long.select(F.monotonically_increasing_id().alias("id"), "*"), "numbered")


def _grams(numbered: DataFrame, number: str, size: str) -> DataFrame:
    """Signatures by each run of seven characters they contain, as their number and length."""
    starts = F.sequence(F.lit(1), F.length("sig") - WINDOW + 1)
    return numbered.select(
        "block", F.col("id").alias(number), F.length("sig").alias(size),
        F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("sig", i, F.lit(WINDOW))))).alias("gram"))


def _identical(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Digests that agree in block size and both signatures score 100."""
    whole = lambda df, name: df.groupBy("digest").agg(
        F.array_sort(F.collect_set(F.struct("block", "sig"))).alias("key")).withColumnRenamed("digest", name)
    return whole(files, "file_digest").join(whole(targets, "target_digest"), "key").select(
        "file_digest", "target_digest", F.lit(100).cast("bigint").alias("score"))


def ssdeep_scores(files: DataFrame, targets: DataFrame, min_score: int = C.SSDEEP_MIN_SCORE,
                  column: str = "ssdeep", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(file_digest, target_digest, score)`` of all pairs that reach the score.

    A pair scores only when two signatures of equal block size share seven characters in a row,
    which is the join key. Signatures too different in length are dropped inside the join.
    """
    left, right = (materialize(_signatures(df, column), "signatures") for df in (files, targets))
    ln, rn = _numbered(left), _numbered(right)
    lg, rg = spread_hot_keys(_grams(ln, "a", "size_a"), _grams(rn, "b", "size_b"), ["block", "gram"], rows_per_task)
    reach = (F.col("size_a") + F.col("size_b")) * ((101 - min_score) / 100 + 1 / DIGEST_CHARS)
    near = F.abs(F.col("size_a") - F.col("size_b")) <= reach
    same = (lg["block"] == rg["block"]) & (lg["gram"] == rg["gram"]) & (lg["salt"] == rg["salt"])
    # A pair shares many runs, so it is numbers that meet; each pair is given its texts once. The runs are many times
    # larger than the files of the signatures, by which Spark would broadcast them.
    pairs = lg.hint("merge").join(rg, same & near).select("a", "b").distinct()
    pairs = pairs.join(ln.select(F.col("id").alias("a"), "block", F.col("sig").alias("sig_a")), "a").join(
        rn.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").select("block", "sig_a", "sig_b")
    scored = pairs.withColumn("score", indel_score("sig_a", "sig_b", "block")).filter(
        F.col("score") >= min_score)
    by_left = left.select(F.col("digest").alias("file_digest"), "block", F.col("sig").alias("sig_a"))
    by_right = right.select(F.col("digest").alias("target_digest"), "block", F.col("sig").alias("sig_b"))
    found = scored.join(by_left, ["block", "sig_a"]).join(by_right, ["block", "sig_b"]).select(
        "file_digest", "target_digest", "score")
    return found.unionByName(_identical(left, right)).groupBy("file_digest", "target_digest").agg(
        F.max("score").alias("score"))


def ssdeep_matches(files: DataFrame, targets: DataFrame,
                   min_score: int = C.SSDEEP_MIN_SCORE) -> DataFrame:
    """Files that reach the score with some target, with the best one."""
    pairs = ssdeep_scores(files, targets, min_score)
    best = pairs.groupBy("file_digest").agg(F.max("score").cast("double").alias("score"))
    kind = F.format_string("ssdeep (%d%%)", F.col("score").cast("bigint"))
    return files.join(best, F.col("ssdeep") == F.col("file_digest")).drop("file_digest").withColumn(
        "match_type", kind)


# --- locality digests --------------------------------------------------------------------------

_PLANES = ["g1a", "g1b", "g2a", "g2b", "g3a", "g3b"]
_PACKED = ["id", "check", "len", "q1", "q2", *_PLANES]
_EVEN_BITS = 0x55555555
_MAX_BUDGET = 3
#: Digests of either side of a cell, and of a tile of it.
PAIR_ROWS = 25_000
_TILE = (8, 8192)


def _number(text: Column) -> Column:
    """Hex digits as a number, never NULL: that keeps the join condition short."""
    return F.coalesce(F.conv(text, 16, 10).cast("bigint"), F.lit(0))


def _planes(body: Column) -> dict[str, Column]:
    """The 128 two-bit codes in unary: plane k holds, per code, whether it is at least k."""
    evens = F.lit(_EVEN_BITS).cast("bigint")
    words = [_number(F.substring(body, 1 + 8 * i, 8)) for i in range(8)]
    low = [w.bitwiseAND(evens) for w in words]
    high = [F.shiftright(w, 1).bitwiseAND(evens) for w in words]
    plane = {1: [h.bitwiseOR(l) for h, l in zip(high, low)], 2: high,
             3: [h.bitwiseAND(l) for h, l in zip(high, low)]}
    pack = lambda w: (w[0].bitwiseOR(F.shiftleft(w[1], 1)).bitwiseOR(F.shiftleft(w[2], 32))
                      .bitwiseOR(F.shiftleft(w[3], 33)))
    return {f"g{k}{half}": pack(plane[k][start:start + 4])
            for k in plane for half, start in (("a", 0), ("b", 4))}


def _packed(df: DataFrame, column: str) -> DataFrame:
    """Distinct valid digests as numbers: checksum, length and quartile codes, and code planes.

    The table is written once, with a number per digest that stands for it in the join.
    """
    bare = F.upper(F.regexp_replace(column, "^T1", ""))
    rows = df.select(F.col(column).alias("digest"), bare.alias("hex")).dropna().distinct().filter(
        F.col("hex").rlike("^[0-9A-F]{70}$"))
    digits = lambda *at: _number(F.concat(*[F.substring("hex", i, 1) for i in at])).cast("int")
    cut = rows.select(
        "digest", digits(1, 2).alias("check"), digits(4, 3).alias("len"), digits(5).alias("q1"),
        digits(6).alias("q2"), F.substring("hex", 7, _HEX_BODY).alias("body"))
    planes = [c.alias(n) for n, c in _planes(F.col("body")).items()]
    return materialize(cut.select(F.monotonically_increasing_id().alias("id"), "*", *planes), "packed")


def _length_gaps(threshold: int) -> list[int]:
    """Gaps of the length code that a match may have."""
    near = [gap for gap in range(129) if (gap if gap <= 1 else 12 * gap) <= threshold]
    return sorted({step % 256 for gap in near for step in (gap, -gap)})


def _stretch(length: Column, step: int) -> Column:
    return F.floor(length / step).cast("int")


def _ring(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    gap = np.abs(a.astype(np.int64) - b)
    return np.minimum(gap, size - gap)


def _head_distances(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """The share of length and quartile codes in the distances of packed digests."""
    length = _ring(a["len"], b["len"], 256)
    total = np.where(length <= 1, length, length * 12)
    for name in ("q1", "q2"):
        gap = _ring(a[name], b[name], 16)
        total = total + np.where(gap <= 1, gap, (gap - 1) * 12)
    return total


def _distances(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Distances of packed digests, row by row; a code difference of three weighs six, any other its own size."""
    total = _head_distances(a, b) + (a["check"] != b["check"])
    for half in "ab":
        x = [a[f"g{k}{half}"] ^ b[f"g{k}{half}"] for k in (1, 2, 3)]
        total += sum(np.bitwise_count(p).astype(np.int64) for p in x) + 3 * np.bitwise_count(x[0] & x[1] & x[2]).astype(np.int64)
    return total


def _pick(rows: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {n: v[at] for n, v in rows.items()}


def _by_head(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in the order of their length and quartile codes, where each such head starts, and how many rows it has."""
    head = rows["len"].astype(np.int64) << 8 | rows["q1"].astype(np.int64) << 4 | rows["q2"]
    order = np.argsort(head, kind="stable")
    _, starts, sizes = np.unique(head[order], return_index=True, return_counts=True)
    return _pick(rows, order), starts, sizes


def _close_pairs(files: dict[str, np.ndarray], targets: tuple, max_distance: int) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of the pairs within the distance; ``targets`` are ordered by head.

    Files of one head meet the targets of the heads near enough, tile by tile. There the distance of the heads and the
    middle plane are a lower bound that most pairs exceed; the others are compared as a whole.
    """
    files, file_starts, file_sizes = _by_head(files)
    targets, starts, sizes = targets
    heads = _pick({n: targets[n] for n in ("len", "q1", "q2")}, starts)
    for first, n in zip(file_starts.tolist(), file_sizes.tolist()):
        apart = _head_distances({name: files[name][first:first + 1] for name in heads}, heads)
        near = np.flatnonzero(apart <= max_distance)
        if not len(near):
            continue
        some = sizes[near]
        # Places of all rows of these heads, one range after the other.
        places = np.arange(some.sum()) + np.repeat(starts[near] - np.cumsum(some) + some, some)
        left = np.repeat(np.minimum(max_distance - apart[near], 255).astype(np.uint8), some)
        middle = [targets[plane][places] for plane in ("g2a", "g2b")]
        for i in range(first, first + n, _TILE[0]):
            own = _pick(files, slice(i, min(i + _TILE[0], first + n)))
            for j in range(0, len(places), _TILE[1]):
                tile = slice(j, j + _TILE[1])
                least = (np.bitwise_count(own["g2a"][:, None] ^ middle[0][tile])
                         + np.bitwise_count(own["g2b"][:, None] ^ middle[1][tile]))
                x, y = np.nonzero(least <= left[tile])
                if len(x):
                    one, other = _pick(own, x), _pick(targets, places[tile][y])
                    found = _distances(one, other)
                    close = found <= max_distance
                    if close.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(one["id"][close]), pa.array(other["id"][close]), pa.array(found[close])],
                            names=["a", "b", "distance"])


def _compare(max_distance: int):
    """Pairs of rows sorted by cell, targets (side 0) before files; the targets of one cell are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ordered = None, [], None
        for batch in batches:
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ["stretch", "salt", "side", *_PACKED]}
            rows |= {n: rows[n].view(np.uint64) for n in _PLANES}  # bits are counted without a sign
            turn = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
            for n in ("stretch", "salt", "side"):
                turn |= np.diff(rows[n]) != 0
            starts = [0, *(np.flatnonzero(turn) + 1).tolist()] if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                now = (rows["stretch"][start], rows["salt"][start])
                if now != cell:
                    cell, held, ordered = now, [], None
                part = {n: rows[n][start:end] for n in _PACKED}
                if rows["side"][start] == 0:
                    held.append(part)
                elif held:
                    if ordered is None:
                        ordered = _by_head({n: np.concatenate([h[n] for h in held]) for n in _PACKED})
                    yield from _close_pairs(part, ordered, max_distance)
    return run


def tlsh_distances(files: DataFrame, targets: DataFrame, max_distance: int = C.TLSH_MAX_DISTANCE,
                   column: str = "tlsh", budget: int = 2, length_step: int = 8,
                   rows_per_task: int = PAIR_ROWS) -> DataFrame:
    """``(file_digest, target_digest, distance)`` of all pairs within the distance.

    The length codes of two digests within the distance are near. Files are dealt by stretches of ``length_step`` codes,
    targets into every stretch that may hold a match, and both into cells of at most about ``rows_per_task`` rows a side,
    in which files meet the targets whose length and quartile codes are near enough together, a tile at a time. Memory is
    that of one cell; the pairs of a stretch grow with files times targets. ``budget`` (1 to 3) is accepted as before and changes nothing.
    """
    if not 1 <= budget <= _MAX_BUDGET:
        raise ValueError(f"budget must be 1..{_MAX_BUDGET}")
    a, b = _packed(files, column), _packed(targets, column)
    near = F.array(*[F.lit(gap) for gap in _length_gaps(max_distance)])
    stretches = F.array_distinct(F.transform(near, lambda gap: _stretch((F.col("len") + gap) % 256, length_step)))
    left, right = spread_hot_keys(a.select(*_PACKED, _stretch(F.col("len"), length_step).alias("stretch")),
                                  b.select(*_PACKED, F.explode(stretches).alias("stretch")), ["stretch"], rows_per_task)
    cells = [F.col(c) for c in ("stretch", "salt")]
    rows = right.withColumn("side", F.lit(0)).unionByName(left.withColumn("side", F.lit(1)))
    # A number of its own: Spark would put cells together by their few bytes.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, *cells).sortWithinPartitions(*cells, "side", "len", "q1", "q2")
    found = dealt.select("stretch", "salt", "side", *_PACKED).mapInArrow(
        _compare(max_distance), "a bigint, b bigint, distance bigint")
    named = lambda df, key, name: df.select(F.col("id").alias(key), F.col("digest").alias(name))
    return found.join(named(a, "a", "file_digest"), "a").join(named(b, "b", "target_digest"), "b").select(
        "file_digest", "target_digest", "distance")


def tlsh_matches(files: DataFrame, targets: DataFrame,
                 max_distance: int = C.TLSH_MAX_DISTANCE) -> DataFrame:
    """Files within the distance of some target, with the smallest one."""
    pairs = tlsh_distances(files, targets, max_distance)
    best = pairs.groupBy("file_digest").agg(F.min("distance").cast("double").alias("score"))
    kind = F.format_string("tlsh (diff=%d)", F.col("score").cast("bigint"))
    return files.join(best, F.col("tlsh") == F.col("file_digest")).drop("file_digest").withColumn(
        "match_type", kind)


def fuzzy_matches(files: DataFrame, targets: DataFrame, min_score: int = C.SSDEEP_MIN_SCORE,
                  max_distance: int = C.TLSH_MAX_DISTANCE) -> DataFrame | None:
    """Union of both similarity matches, for the digests both sides have."""
    both = lambda c: c in files.columns and c in targets.columns
    parts = []
    if both("ssdeep"):
        parts.append(ssdeep_matches(files, targets, min_score))
    if both("tlsh"):
        parts.append(tlsh_matches(files, targets, max_distance))
    return reduce(DataFrame.unionByName, parts) if parts else None
