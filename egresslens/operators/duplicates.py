"""Near-duplicate contents by exact Jaccard similarity of their word shingles.

The shingles of a text are its distinct runs of ``k`` words (a shorter text is one run). All shingles
have one order, rare ones first. Of two texts of similarity ``t`` each has, among its first
``n - ceil(t * n) + 1`` shingles, one that the other has there too, so an inverted index over these
prefixes finds every pair. Lengths and the places of the common shingle bound the similarity from
above and drop most candidates before any list is compared.

Only classes are wanted, the connected parts of pairs that reach the similarity, so no group is paired
with itself: each text of an index entry meets the entry's first text; what that holds together is done,
and only texts of an entry that are in different classes by then meet each other, in salted shares. A
family of near copies costs its size. Nothing is capped, and no class misses a text.

Texts are written once, as their words; shingles are made from them where they are read, as they take more room. To be
counted, shingles go to the tasks of their ranges in blocks, each with its text, and only shared ones come back as rows.

Defined results: null texts and texts without a word stand alone; equal word lists are one text; repeated
rows are in one class. ``class_id`` is the smallest key of the class.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from egresslens.functions.text import let
from egresslens.operators.components import components, rooted
from egresslens.operators.skew import spread_hot_keys
from egresslens.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"
#: Texts of an index entry on either side of one task.
ROWS_PER_TASK = 2_000
#: Shingles that one task counts, and those that are dealt at once.
COUNTED, DEALT = 1_000_000, 1_000_000


def words(text: Column) -> Column:
    """Words in lower case (A to Z), without the blanks between them."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANKS), "")


def shingles(held: Column, k: int) -> Column:
    """Distinct hashes of the runs of ``k`` words; one of all words where there are fewer."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(held) - k, F.lit(0)))
    # Words one by one: a slice would copy each run. Places behind the last word are NULL and do not change the hash.
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(held, i + j) for j in range(k)])))


def _runs(k: int) -> Column:
    """The shingles of a ``text`` of words with one blank between them."""
    return let(F.split("text", " "), lambda held: shingles(held, k))


def _deal(ids: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, parts: int) -> Iterator[tuple]:
    """(part, first id, steps from id to id, shingles) of the shingles in each of ``parts`` ranges of equal width.

    Steps have as few bytes as the largest needs; they are taken modulo 2 ** 64, so ids may come in any order.
    """
    part = ((shingles.view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
    shingles, owners = shingles[order], np.repeat(ids, sizes)[order].view(np.uint64)
    ends = np.bincount(part.astype(np.int64), minlength=parts).cumsum()
    for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
        if start < end:
            steps = np.diff(owners[start:end], prepend=owners[start])
            yield i, int(owners[start].view(np.int64)), steps.astype(np.min_scalar_type(steps.max())).tobytes(), shingles[start:end].tobytes()


def _shared(blocks: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, id, often) of the shingles that come more than once in the blocks of ``_deal``."""
    held = [(np.frombuffer(runs, np.int64), first, steps) for first, steps, runs in blocks]
    if not held:
        return (np.empty(0, np.int64),) * 3
    shingles = np.concatenate([runs for runs, _, _ in held])
    ids = np.concatenate([
        (np.frombuffer(steps, f"u{len(steps) // len(runs)}").cumsum(dtype=np.uint64) + np.array(first).astype(np.uint64)).view(np.int64)
        for runs, first, steps in held])
    order = np.argsort(shingles)
    shingles, ids = shingles[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
    often = np.diff(starts, append=len(shingles))
    often = np.repeat(often, often)
    kept = often > 1
    return shingles[kept], ids[kept], often[kept]


def shared_shingles(texts: DataFrame, parts: int) -> DataFrame:
    """(shingle, id, often) of the shingles of ``(id, shingles)`` that more than one text has, counted by ``parts`` tasks."""
    def deal(batches):
        held, n = [], 0
        for batch in batches:
            lists = batch.column("shingles")
            sizes = np.diff(lists.offsets.to_numpy())
            held.append((batch.column("id").to_numpy(), sizes, lists.flatten().to_numpy()))
            n += len(held[-1][2])
            if n >= DEALT:
                yield from blocks(held)
                held, n = [], 0
        if n:
            yield from blocks(held)

    def blocks(held):
        rows = list(_deal(*(np.concatenate(x) for x in zip(*held)), parts))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (
            pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "first", "steps", "runs"])

    def count(batches):
        found = _shared(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("first", "steps", "runs"))))
        for at in range(0, len(found[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at:at + 100_000]) for x in found], names=["shingle", "id", "often"])

    dealt = texts.select("id", "shingles").mapInArrow(deal, "part int, first bigint, steps binary, runs binary")
    return dealt.repartition(parts, "part").mapInArrow(count, "shingle bigint, id bigint, often bigint")


def prefix_index(texts: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, n, place) of the first shingles of every text ``(node, shingles)``, rare ones first.

    Entries of a single text are left out. Such shingles are the rarest and stand before all others, so their number is
    enough to place the others, and they are not sent to their texts. Texts may bring a number ``id`` and their size ``n``.
    """
    if "id" not in texts.columns:
        numbered = texts.withColumns({"n": F.size("shingles"), "id": F.monotonically_increasing_id()})
        texts = materialize(numbered, "numbered-texts")
    total = texts.agg(F.sum("n")).first()[0] or 0
    shared = shared_shingles(texts, max(1, -(-total // COUNTED))).filter("often > 1")
    ranked = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("ranked"))
    ranked = texts.select("id", "node", "n").join(ranked, "id")
    size = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    alone = F.col("n") - F.size("ranked")
    first = ranked.select("node", "n", alone.alias("alone"), F.posexplode(
        F.slice("ranked", F.lit(1), F.greatest(size - alone, F.lit(0)))).alias("at", "s"))
    return first.select(F.col("s.shingle").alias("shingle"), "node", "n", (F.col("alone") + F.col("at")).alias("place"))


def _may_reach(left: str, right: str, similarity: float) -> Column:
    """Whether two texts can be similar that have their first common shingle at these places."""
    n, m, i, j = (F.col(f"{side}.{name}") for name in ("n", "place") for side in (left, right))
    wanted = F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)
    return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9) & (F.least(n - i, m - j) >= wanted)


def _pair(left: str, right: str) -> list[Column]:
    return [F.least(f"{left}.node", f"{right}.node").alias("a"), F.greatest(f"{left}.node", f"{right}.node").alias("b")]


def similar(pairs: DataFrame, texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """The pairs (a, b) of texts ``(node, text)`` whose Jaccard similarity reaches the bound.

    Shingles are made behind the join, which may have to send all texts.
    """
    lists = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    lists = materialize(lists.select("node", _runs(k).alias("shingles")), "compared-texts")
    side = lambda name: lists.select(F.col("node").alias(name), F.col("shingles").alias(f"in_{name}"))
    both = F.size(F.array_intersect("in_a", "in_b"))
    whole = F.size("in_a") + F.size("in_b") - both
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(both >= whole * similarity - 1e-9).select("a", "b")


def near_duplicates(documents: DataFrame, key: str, text: str = "text", similarity: float = 0.8, k: int = 5,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, class_id, class_size, n_links) of every row; ``n_links`` counts the similar texts that were looked for."""
    named = documents.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    joined = F.concat_ws(" ", "words")
    named = materialize(named.select(
        "key", F.unhex(F.md5(joined)).alias("node"), F.when(F.size("words") > 0, joined).alias("text"),
        F.size(shingles(F.col("words"), k)).alias("n"), F.monotonically_increasing_id().alias("id")), "named")
    whole = named.filter("text is not null")
    # Of equal texts the first row counts; the others are few or many, but only numbers.
    several = whole.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    repeats = materialize(whole.select("id", "node").join(several, "node").filter("id > first").select("id"), "repeats")
    texts = whole.join(repeats, "id", "left_anti").select("id", "node", "n", "text")
    index = materialize(prefix_index(texts.select("id", "node", "n", _runs(k).alias("shingles")), similarity), "prefix-index")

    leaders = index.groupBy("shingle").agg(F.min(F.struct("node", "n", "place")).alias("l"))
    led = index.alias("r").join(leaders, "shingle").filter((F.col("r.node") != F.col("l.node")) & _may_reach("l", "r", similarity))
    tried = materialize(led.select(*_pair("l", "r")).distinct(), "led-pairs")
    links = materialize(similar(tried, texts, similarity, k), "led-links")
    roots = materialize(components(links), "roots")

    held = rooted(index, roots)
    split = held.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("shingle")
    held = materialize(held.join(split, "shingle", "left_semi"), "split-entries")
    left, right = spread_hot_keys(held, held, ["shingle"], rows_per_task)
    apart = ((F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.salt") == F.col("r.salt"))
             & (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & _may_reach("l", "r", similarity))
    rest = left.alias("l").join(right.alias("r"), apart).select(*_pair("l", "r")).distinct()
    more = materialize(similar(materialize(rest.join(tried, ["a", "b"], "left_anti"), "pairs"), texts, similarity, k), "links")
    if not more.isEmpty():
        roots = components(roots.filter("node > root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))

    every = links.union(more)
    degree = (every.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
    # Rows without a word are classes of their own, told apart by their place in the written table.
    alone = F.concat(F.lit("row"), F.col("id").cast("string")).cast("binary")
    rows = rooted(named.select("key", F.when(F.col("text").isNull(), alone).otherwise(F.col("node")).alias("node")), roots)
    rows = materialize(rows.join(degree, "node", "left"), "classed")
    classes = rows.groupBy("root").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(classes, "root").select(
        F.col("key").alias(key), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
