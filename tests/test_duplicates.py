"""Near-duplicate classes against all pairs of small texts."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from egresslens.operators import duplicates


def plain_classes(texts, similarity=0.8, k=5):
    """Class of every row by comparing all pairs; rows without a word are alone."""
    held = []
    for text in texts:
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        held.append({tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else None)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(held):
        for j in range(i):
            y = held[j]
            if x is not None and y is not None and len(x & y) >= similarity * len(x | y) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def changed(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10_000)}"
    return out


@pytest.mark.parametrize("rows_per_task", [2_000, 5])
def test_classes_equal_all_pairs(spark, rows_per_task):
    """Families, a passage that many texts share, short and empty texts, repeated rows; hot entries cut into shares."""
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(400)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d f"]
    for _ in range(12):
        base = [word() for _ in range(draw.randint(8, 60))]
        texts += [" ".join(changed(draw, base, draw.randint(0, 3))) for _ in range(draw.randint(1, 5))]
    for _ in range(25):
        base = passage + [word() for _ in range(draw.randint(5, 30))]
        texts += [" ".join(base), " ".join(changed(draw, base, 1))]
    texts += texts[10:14]
    df = spark.createDataFrame([(i, t, "node", 1) for i, t in enumerate(texts)], "id long, text string, node string, n int")
    got = {r["id"]: r for r in duplicates.near_duplicates(df, "id", rows_per_task=rows_per_task).collect()}
    want = plain_classes(texts)
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    assert all(got[i]["class_size"] == want.count(want[i]) for i in range(len(texts)))
    assert duplicates.near_duplicates(df.limit(0), "id").count() == 0


def test_a_family_costs_its_size(spark):
    """The pairs compared for 400 near copies are a small multiple of the texts, not their square."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(changed(draw, base, 1)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = duplicates.near_duplicates(df, "id").collect()
    assert {r["class_id"] for r in rows} == {0} and sum(r["n_links"] for r in rows) < 2 * 20 * 400


def test_index_of_shared_shingles_equals_a_plain_one(spark):
    draw = random.Random(17)
    lists = {i: draw.sample(range(60), draw.randint(1, 30)) + [1000 + 100 * i + j for j in range(draw.randint(0, 12))] for i in range(25)}
    texts = spark.createDataFrame([(str(i).encode(), held) for i, held in lists.items()], "node binary, shingles array<bigint>")
    often = collections.Counter(x for held in lists.values() for x in held)
    want = set()
    for i, held in lists.items():
        n = len(held)
        first = sorted(held, key=lambda x: (often[x], x))[:n - math.ceil(n * 0.8 - 1e-9) + 1]
        want |= {(x, str(i).encode(), n, place) for place, x in enumerate(first) if often[x] > 1}
    index = duplicates.prefix_index(texts, 0.8)
    assert index.columns == ["shingle", "node", "n", "place"]
    assert {(r[0], bytes(r[1]), r[2], r[3]) for r in index.collect()} == want
    # Shingles of one text are left out below the join, before rows go to their texts.
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "> 1)" in plan[plan.index("Join"):]


def test_shingles_are_hashes_of_whole_runs(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "a", "b", "c"],), (["a", "b"],), ([],)], "w array<string>")
    got = rows.select(duplicates.shingles(F.col("w"), 3).alias("s"), F.xxhash64("w").alias("whole"),
                      F.array(*[F.xxhash64(F.slice("w", i, 3)) for i in (1, 2, 3)]).alias("runs")).collect()
    assert got[0]["s"] == got[0]["runs"] and got[1]["s"] == [got[1]["whole"]] and got[2]["s"] == [got[2]["whole"]]
    plan = rows.select(duplicates.shingles(F.col("w"), 3))._jdf.queryExecution().analyzed().toString()
    assert "slice(" not in plan


def test_shingles_are_counted_in_blocks(spark, monkeypatch):
    """Ids in any order and far apart, shingles of either sign; every shingle is sent once, without a row of its own."""
    monkeypatch.setattr(duplicates, "DEALT", 40)
    draw = random.Random(8)
    pool = [draw.randrange(-2**63, 2**63) for _ in range(300)]
    lists = {draw.choice([7, 1 << 33, 5 << 40, 2**62]) + i: draw.sample(pool, draw.randint(0, 20)) for i in range(60)}
    often = collections.Counter(x for held in lists.values() for x in held)
    want = {(x, i, often[x]) for i, held in lists.items() for x in held if often[x] > 1}
    ids, sizes = np.array(list(lists)), np.array([len(held) for held in lists.values()])
    runs = np.array([x for held in lists.values() for x in held])
    for parts in (1, 3, 300):
        blocks = list(duplicates._deal(ids, sizes, runs, parts))
        by_part = [duplicates._shared(b[1:] for b in blocks if b[0] == part) for part in range(parts)]
        assert {tuple(map(int, row)) for found in by_part for row in zip(*found)} == want
    texts = spark.createDataFrame(list(lists.items()), "id long, shingles array<bigint>").repartition(2)
    found = duplicates.shared_shingles(texts, 3)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_written_without_shingles(spark, monkeypatch):
    kept, materialize = {}, duplicates.materialize
    monkeypatch.setattr(duplicates, "materialize", lambda df, name: kept.setdefault(name, materialize(df, name)))
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "A  b c d e f g"), (3, None), (3, "")], "id long, text string")
    rows = duplicates.near_duplicates(df, "id").collect()
    assert sorted((r["id"], r["class_id"], r["class_size"]) for r in rows) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (3, 3, 1)]
    whole = [name for name, table in kept.items() if "shingles" in table.columns and table.count()]
    assert whole == [] and kept["repeats"].count() == 1
