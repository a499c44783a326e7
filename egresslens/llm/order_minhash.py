"""Near-duplicate classes by Order MinHash and banded alignment.

A text is the sequence of its lower-cased words. Its k-mers are runs of five words, each labelled
with how often the run has occurred before. Each of ``sketches`` hash functions picks the two
labelled k-mers with the smallest values and keeps them in the order of the text; the hash of that
ordered pair is one key. Texts that share a key are candidates, and a candidate pair is a link when
the words of one can be changed into the other's with edits of at most a fifth of the longer text.
Classes are the connected parts of links.

Exact copies are one node from the start. A key of up to ``small`` nodes brings all its pairs. A
larger key (a passage that many texts share, or a large family) brings each node beside the key's
first node: beside one of its leaders at first, beside the others where that does not hold the key
together, and nodes of keys still in several classes are dealt again under every two of those keys.
What a large key then still holds in several classes is dealt once more by k-mers (``crowd_links``): in
one order of all k-mers, rare ones first, two texts of similarity 0.8 have one in common among the
first fifth of each, so a k-mer of up to ``small`` texts brings all pairs in different classes. More
frequent ones bring each text beside the first of about its length, and then every pair still in
different classes: a group is paired with itself only as far as links do not hold it together. Two
texts with similarity 0.8 by five-word runs share a key with a probability above 0.999999, and those
that share one end in one class.

Defined results: rows without a word (null, empty, blank) stand alone. Texts under five words have
no k-mer and meet exact copies only. The class id is the smallest doc_id of the class (null when it
has none); of repeated rows one is kept. Other columns play no part. Pairs that are in one class
already are not compared again for ``n_links``, which counts the links that were looked for.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from egresslens.llm.common import HashMemo, map_batches
from egresslens.operators.skew import spread_hot_keys
from egresslens.session import materialize

KMER = 5
FIRST, SECOND, THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: K-mers hashed in one go; cells of a band that are held at once.
WIDE, DENSE = 1 << 21, 1 << 22
#: Places of the table that orders k-mers by frequency; those that share one are ordered as if equally frequent.
TALLIES = 1 << 21
#: Texts of a k-mer on either side of one task; words by which texts are about of one length.
CROWD, LENGTHS = 2_000, 1.1


@dataclass(frozen=True)
class Params:
    sketches: int = 16
    similarity: float = 0.8
    small: int = 16


def text_key(column: str = "text") -> Column:
    """Exact identity of a text."""
    return F.unhex(F.md5(column))


def has_words(column: str = "text") -> Column:
    return F.coalesce(F.col(column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * SECOND
    return values ^ (values >> np.uint64(32))


def labelled_kmers(words: np.ndarray) -> np.ndarray:
    """Hash of each k-mer and of its number among equal k-mers, in text order."""
    if len(words) < KMER:
        return np.empty(0, np.uint64)
    kmers = np.zeros(len(words) - KMER + 1, np.uint64)
    for i in range(KMER):
        kmers = kmers * FIRST + words[i:len(words) - KMER + 1 + i]
    kmers = _mixed(kmers)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    if not fresh.all():
        starts = np.flatnonzero(fresh)
        number = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
        labelled = np.empty_like(kmers)
        labelled[order] = ranked + number.astype(np.uint64) * THIRD  # the first of its kind keeps its value
        kmers = labelled
    return kmers


def sketch(kmers: np.ndarray, sketches: int) -> np.ndarray:
    """One key per hash function from the two smallest k-mers in text order."""
    n = len(kmers)
    if not n:
        return np.empty(0, np.uint64)
    seeds = _mixed((np.arange(sketches, dtype=np.uint64) + np.uint64(1)) * THIRD)
    places = np.zeros((sketches, 2), np.int64)
    step = max(1, WIDE // n)
    for at in range(0, sketches, step):
        values = _mixed((kmers[None, :] ^ seeds[at:at + step, None]) * FIRST)
        if n > 2:
            places[at:at + step] = np.argpartition(values, 1, axis=1)[:, :2]
        else:
            places[at:at + step] = [0, n - 1]
    places.sort(axis=1)
    return _mixed(_mixed(kmers[places[:, 0]] * FIRST + seeds) * THIRD + kmers[places[:, 1]])


def sketched(documents: DataFrame, params: Params) -> DataFrame:
    """(doc_id, node, n_words, keys, codes) of every row with a word, from one pass over the texts."""
    def run(batches):
        ids = HashMemo()
        for batch in batches:
            counts, keys, codes = [], [], []
            for text in batch.column(2).to_pylist():
                tokens = text.encode().lower().split()
                words = np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens))
                counts.append(len(words))
                keys.append(sketch(labelled_kmers(words), params.sketches).view(np.int64))
                codes.append((words >> np.uint64(32)).astype(np.uint32).tobytes())
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int32()),
                 pa.ListArray.from_arrays(offsets, flat), pa.array(codes, pa.binary())],
                names=["doc_id", "node", "n_words", "keys", "codes"])

    rows = documents.filter(has_words()).select("doc_id", text_key().alias("node"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, node binary, n_words int, keys array<bigint>, codes binary")


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, node, n_words) rows of keys of two nodes or more, with the key's smallest node as ``leader`` and its size ``n``."""
    sizes = (keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1"))
    return materialize(keyed.join(sizes, "key"), "shared-keys")


def small_pairs(shared: DataFrame, params: Params) -> DataFrame:
    """All pairs (a < b) of keys of up to ``small`` nodes whose lengths allow a link."""
    small = shared.filter(F.col("n") <= params.small).select("key", "node", "n_words")
    left, right = small.alias("l"), small.alias("r")
    short, long = F.least("l.n_words", "r.n_words"), F.greatest("l.n_words", "r.n_words")
    return (left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node"))
                      & (short >= params.similarity * long))
            .select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))


def led_pairs(shared: DataFrame, params: Params) -> DataFrame:
    """Pairs (leader, node) of larger keys."""
    return shared.filter((F.col("n") > params.small) & (F.col("node") > F.col("leader"))).select(
        F.col("leader").alias("a"), F.col("node").alias("b"))


def between_classes(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct pairs whose nodes are in different classes by now."""
    root = lambda name, alias: roots.select(F.col("node").alias(name), F.col("root").alias(alias))
    return (pairs.distinct().join(root("a", "__x"), "a", "left").join(root("b", "__y"), "b", "left")
            .filter(F.coalesce("__x", "a") != F.coalesce("__y", "b")).select("a", "b"))


def split_keys(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, n_words, ...) rows, with ``root``, of the keys whose nodes are in several classes."""
    held = _rooted(rows, roots)
    split = held.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    return held.join(split, "key", "left_semi")


def candidates(rows: DataFrame, params: Params) -> DataFrame:
    """Shared keys of sketched rows."""
    return shared_keys(rows.select("node", "n_words", F.explode("keys").alias("key")).distinct())


def finer_pairs(large: DataFrame, params: Params) -> DataFrame:
    """Pairs in different classes that share two of the larger keys that links do not hold together, dealt by the same rule."""
    both = (large.groupBy("node", "n_words").agg(F.sort_array(F.collect_set("key")).alias("keys"))
            .filter(F.size("keys") > 1)
            .select("node", "n_words", F.explode(F.expr(
                "flatten(transform(keys, (x, i) -> transform(slice(keys, i + 2, size(keys)), y -> xxhash64(x, y))))"
            )).alias("key")))
    shared = shared_keys(both)
    return small_pairs(shared, params).union(led_pairs(shared, params))


class Links:
    """Verified links in written tables, and the classes they make so far.

    Classes are joined from (node, root) and the new links only; links of earlier steps are kept for their count.
    """

    def __init__(self, rows: DataFrame, params: Params) -> None:
        self.codes = rows.select("node", "codes")
        self.params, self.found = params, []
        # no rows, from a table: rows given by the driver would start Python workers of another kind beside these
        self.roots = rows.select("node", F.col("node").alias("root")).limit(0)

    def add(self, pairs: DataFrame) -> None:
        """Verify candidate pairs between classes and join the classes of those that are links."""
        pairs = materialize(between_classes(pairs, self.roots) if self.found else pairs.distinct(), "pairs")
        more = materialize(verified(pairs, self.codes, self.params), "verified")
        if more.isEmpty():
            return
        held = self.roots.filter("node > root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        self.roots = components(held.union(more) if self.found else more)
        self.found.append(more)

    def degrees(self) -> DataFrame:
        """(node, n_links) of linked nodes."""
        every = self.codes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
        for more in self.found:
            every = every.union(more)
        every = every.distinct()
        return (every.select(F.col("a").alias("node")).union(every.select("b"))
                .groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))


def prefix_size(n: int, similarity: float) -> int:
    """So many of the first of n k-mers, in any common order, meet those of each text of that Jaccard similarity."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _code_kmers(codes: bytes) -> np.ndarray:
    return labelled_kmers(np.frombuffer(codes, np.uint32).astype(np.uint64))


def _tallied(crowd: DataFrame) -> np.ndarray:
    """How many k-mers of the texts fall on each place of a table of fixed size."""
    def run(batches):
        counts = np.zeros(TALLIES, np.int64)
        for batch in batches:
            found = [_code_kmers(codes) for codes in batch.column(0).to_pylist()]
            if found:
                counts += np.bincount((np.concatenate(found) % np.uint64(TALLIES)).astype(np.int64), minlength=TALLIES)
        places = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts[places])], names=["place", "n"])

    sums = (map_batches(crowd.select("codes"), run, "place long, n long").groupBy("place")
            .agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(TALLIES, np.int64)
    out[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefix_keys(crowd: DataFrame, params: Params) -> DataFrame:
    """(key, node, n_words, root): the first k-mers of each text, rare ones first, without those of one text."""
    shared = crowd.sparkSession.sparkContext.broadcast(_tallied(crowd))

    def run(batches):
        tallies = shared.value
        for batch in batches:
            keys = []
            for codes in batch.column(3).to_pylist():
                kmers = _code_kmers(codes)
                often = tallies[(kmers % np.uint64(TALLIES)).astype(np.int64)]
                first = np.lexsort((kmers, often))[:prefix_size(len(kmers), params.similarity)]
                keys.append(kmers[first][often[first] > 1].view(np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, flat)],
                                             names=["node", "n_words", "root", "keys"])

    rows = map_batches(crowd.select("node", "n_words", "root", "codes"), run,
                       "node binary, n_words int, root binary, keys array<bigint>")
    return rows.select(F.explode("keys").alias("key"), "node", "n_words", "root")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(left: str, right: str, params: Params) -> Column:
    """Texts of different classes whose lengths allow a link."""
    short, long = (f(f"{left}.n_words", f"{right}.n_words") for f in (F.least, F.greatest))
    return (F.col(f"{left}.root") != F.col(f"{right}.root")) & (short >= params.similarity * long)


def _ordered(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def crowd_links(rows: DataFrame, split: DataFrame, links: Links, params: Params) -> None:
    """Add the links between texts of large keys that are in different classes. split: rows of such keys."""
    nodes = split.select("node", "root").distinct()
    crowd = materialize(rows.select("node", "n_words", "codes").dropDuplicates(["node"]).join(nodes, "node"), "crowd")
    if crowd.isEmpty():
        return
    keyed = materialize(prefix_keys(crowd, params), "crowd-keys")
    sizes = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
             .filter("x < y").select("key", "n"))
    shared = materialize(keyed.join(sizes, "key"), "crowd-shared")
    few = shared.filter(F.col("n") <= params.small)
    few = (few.alias("l").join(few.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node"))
                               & _apart("l", "r", params))
           .select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))
    many = shared.filter(F.col("n") > params.small).drop("n").withColumn(
        "band", F.floor(F.log("n_words") / np.log(LENGTHS)))
    first = many.groupBy("key", "band").agg(F.min(F.struct("node", "root", "n_words")).alias("l"))
    led = (many.alias("r").join(first, ["key", "band"]).filter(_apart("l", "r", params))
           .select(*_ordered("l.node", "r.node")))
    links.add(few.union(led))

    many = materialize(_rooted(many.select("key", "node", "n_words"), links.roots), "crowd-many")
    most = (many.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
            .agg(F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
            .select("key", F.col("most.root").alias("most")))
    if most.isEmpty():
        return
    every = many.join(most, "key").withColumn("other", F.col("root") != F.col("most")).drop("most")
    left, right = spread_hot_keys(every.filter("other"), every, ["key"], CROWD)
    links.add(left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt"))
                                   & _apart("l", "r", params) & (~F.col("r.other") | (F.col("l.node") < F.col("r.node"))))
              .select(*_ordered("l.node", "r.node")))


def edit_limit(similarity: float, longest: int) -> int:
    return int((1 - similarity) * longest + 1e-9)


def _bags_apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edits: words of one text that the other lacks."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    gap = np.bincount(where[:len(a)], minlength=len(values)) - np.bincount(where[len(a):], minlength=len(values))
    return max(int(gap[gap > 0].sum()), int(-gap[gap < 0].sum()))


def _runs_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Another lower bound: one edit touches at most five k-mers."""
    x, y = np.sort(labelled_kmers(a.astype(np.uint64))), np.sort(labelled_kmers(b.astype(np.uint64)))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return -(-(max(len(x), len(y)) - common) // KMER)


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Word edits between two texts by banded alignment, or None beyond ``limit``.

    The band is doubled until the alignment fits in it; a cell outside a band of ``w`` diagonals
    costs more than ``w`` edits, so a result of at most ``w`` is exact.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    head = int(differ[0]) if differ.size else size
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - size:][::-1] != b[len(b) - size:][::-1])
    tail = int(differ[0]) if differ.size else size
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return len(a) + len(b) if len(a) + len(b) <= limit else None
    width, bounded = 16, False
    while True:
        width = min(width, limit)
        wide = (2 * width + 1) * len(a) > DENSE
        edits = _banded(a, b, width) if wide else _furthest(a, b, width)
        if edits <= width:
            return edits
        if width >= limit:
            return None
        if not bounded and (_bags_apart(a, b) > limit or _runs_apart(a, b) > limit):
            return None
        bounded, width = True, 2 * width


def _furthest(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """As ``_banded``, by the furthest place that each diagonal of the band reaches with 0, 1, 2, ... edits.

    Where the next mismatch of every diagonal lies is worked out for the whole band at once, so the
    work beyond that grows with the edits, not with the texts.
    """
    n, m = len(a), len(b)
    goal = m - n + width
    if not 0 <= goal <= 2 * width:
        return width + 1
    padded = np.full(max(m + width, n + width) + width, -1, np.int64)
    padded[width:width + m] = b
    near = np.lib.stride_tricks.sliding_window_view(padded, n)[:2 * width + 1]
    stops = np.full((2 * width + 1, n + 1), n, np.int32)
    np.copyto(stops[:, :n], np.arange(n, dtype=np.int32), where=near != a)
    for stop in stops:  # one diagonal at a time, the band is held once
        stop[:] = np.minimum.accumulate(stop[::-1])[::-1]
    diagonals = np.arange(2 * width + 1)
    ends = np.minimum(n, m - (diagonals - width))
    reach = np.full(2 * width + 1, -1)
    reach[width] = stops[width, 0]
    edits = 0
    while reach[goal] < n and edits < width:
        edits += 1
        low, high = width - edits, width + edits + 1  # diagonals in reach by now
        step = np.where(reach >= 0, reach + 1, -1)
        step[1:] = np.maximum(step[1:], reach[:-1])
        step[:-1] = np.maximum(step[:-1], np.where(reach[1:] >= 0, reach[1:] + 1, -1))
        step = np.minimum(step, ends)[low:high]
        reach[low:high] = np.where(step >= 0, stops[diagonals[low:high], step], -1)
    return edits if reach[goal] >= n else width + 1


def _banded(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Least edits of alignments that stay within ``width`` diagonals of the main one."""
    if abs(len(a) - len(b)) > width:
        return width + 1
    span, far = 2 * width + 1, np.int32(1 << 29)
    steps = np.arange(span, dtype=np.int32)
    padded = np.full(len(b) + 2 * span, 0, np.int64)
    padded[width:width + len(b)] = b.astype(np.int64) + 1  # column j of b stands at place j + width
    row = np.where(steps >= width, steps - width, far).astype(np.int32)
    row[steps - width > len(b)] = far
    for i in range(1, len(a) + 1):
        # place k of the row is column i + k - width
        change = (padded[i - 1:i - 1 + span] != int(a[i - 1]) + 1).astype(np.int32)
        new = row + change
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        low, high = width - i, len(b) - i + width
        if low >= 0:
            new[:low + 1] = far
            new[low] = i
        if high + 1 < span:
            new[high + 1:] = far
        row = np.minimum.accumulate(new - steps) + steps
        if high + 1 < span:
            row[high + 1:] = far
        if row.min() > width:
            return width + 1
    return int(row[len(b) - len(a) + width])


def verified(pairs: DataFrame, rows: DataFrame, params: Params) -> DataFrame:
    """The candidate pairs that are links."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct()
    codes = materialize(rows.select("node", "codes").join(wanted, "node", "left_semi").dropDuplicates(["node"]),
                        "candidate-codes")
    both = (pairs.join(codes.select(F.col("node").alias("b"), F.col("codes").alias("right")), "b")
            .join(codes.select(F.col("node").alias("a"), F.col("codes").alias("left")), "a")
            .select("a", "b", "left", "right"))

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(left, np.uint32), np.frombuffer(right, np.uint32)
                keep.append(edits_within(x, y, edit_limit(params.similarity, max(len(x), len(y)))) is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return map_batches(both, run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node of its part.

    Large-star and small-star rounds in turn; the number of rounds grows with the logarithm of the size.
    """
    def star(edges: DataFrame) -> DataFrame:
        ways = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u > v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        return (large.join(lowest, "u").select(F.explode(F.array(
            F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("a"), F.col("e.m").alias("b")).filter("a > b").distinct())

    def mark(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(edges)
    while True:
        edges = materialize(star(edges), "stars")
        now = mark(edges)
        if now == seen:
            return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
                    .union(edges.select("b", "b")).distinct())
        seen = now


def linked_classes(rows: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(node, root) of linked nodes and (node, n_links), from sketched rows.

    Pairs of small keys and one leader a node come first; what they hold together is not looked at again.
    """
    links = Links(rows, params)
    shared = candidates(rows.select("node", "n_words", "keys"), params)
    led = led_pairs(shared, params)
    nearest = led.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links.add(small_pairs(shared, params).union(nearest))
    large = shared.filter(F.col("n") > params.small).select("key", "node", "n_words", "leader", "n")
    split = materialize(split_keys(large, links.roots), "split-keys")
    if not split.isEmpty():
        links.add(led_pairs(split, params).join(nearest, ["a", "b"], "left_anti"))
        split = materialize(split_keys(split.drop("root"), links.roots), "split-keys")
    if not split.isEmpty():
        links.add(finer_pairs(split, params))
        crowd_links(rows, split_keys(split.drop("root"), links.roots), links, params)
    return links.roots, links.degrees()


def classes(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per document: doc_id, node, class_id, n_links (other texts its text is linked to), kept."""
    rows = materialize(sketched(documents, params), "sketches")
    roots, degree = linked_classes(rows, params)
    nodes = (rows.groupBy("node").agg(F.min("doc_id").alias("least"))
             .join(roots, "node", "left").join(degree, "node", "left")
             .select("node", "least", F.coalesce("root", "node").alias("root"),
                     F.coalesce("n_links", F.lit(0)).alias("n_links")))
    nodes = materialize(nodes, "nodes")
    first = nodes.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first"))
    known = (nodes.join(first, "root")
             .select("node", F.col("first.least").alias("class_id"), "n_links",
                     (F.col("node") == F.col("first.node")).alias("leads")))
    found = (rows.select("doc_id", "node").join(known, "node")
             .select("doc_id", "node", "class_id", "n_links",
                     (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept")))
    alone = documents.filter(~has_words()).select(
        "doc_id", text_key().alias("node"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(True).alias("kept"))
    return found.union(alone)


def survivors(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``documents`` that stay: one of each class and every row without a word."""
    kept = (classes(documents, params).filter("kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"))
            .distinct())
    rows = documents.filter(has_words()).withColumn("__node", text_key())
    same = Window.partitionBy("doc_id", "__node").orderBy(F.lit(0))
    staying = (rows.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.__id"))
                                    & (F.col("d.__node") == F.col("k.__node")), "left_semi")
               .withColumn("__copy", F.row_number().over(same)).filter("__copy = 1"))
    return staying.select(*documents.columns).union(documents.filter(~has_words()))
