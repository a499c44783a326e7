import random

import numpy as np
import pandas as pd

from egresslens.functions import digests as D
from egresslens.operators import fuzzy


def slow_ctph(data):
    """One byte at a time, as the method is described."""
    def signature(block, limit):
        window, state, out, h2, h3 = [0] * 7, D.PIECE_START, "", 0, 0
        for c in data:
            h2 = h2 - sum(window) + 7 * c
            window = window[1:] + [c]
            h3 = ((h3 << 5) ^ c) & 0xFFFFFFFF
            roll = (sum(window) + h2 + h3) & 0xFFFFFFFF
            state = (state * D.PIECE_PRIME & 0xFFFFFFFF) ^ c
            if roll % block == block - 1 and len(out) < limit:
                out += D.B64[state % 64]
                state = D.PIECE_START
        return out, out + D.B64[state % 64]

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(signature(block, 63)[0]) < 32:
        block //= 2
    return f"{block}:{signature(block, 63)[1]}:{signature(block * 2, 31)[1]}"


def test_piecewise_digest_equals_slow_form():
    rng = np.random.default_rng(1)
    for size in (1, 50, 500, 4096, 9000):
        data = rng.integers(1, 256, size, dtype=np.uint8).tobytes()
        assert D.ctph_digest(data) == slow_ctph(data)


def test_common_subsequence():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 64))) for _ in range(40)]
    left, right = pd.Series(texts[:20]), pd.Series(texts[20:])

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]
    assert D.common_subsequence(left, right).tolist() == [slow(a, b) for a, b in zip(left, right)]


def test_locality_digest_shape_and_closeness():
    table = D.pearson_table()
    assert sorted(table.tolist()) == list(range(256))
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    digest = D.locality_digest(data.tobytes(), table)
    assert len(digest) == 70 and D.locality_digest(b"a" * 400, table) is None and D.locality_digest(b"ab", table) is None


def slow_distance(a, b):
    nibble = lambda t, i: int(t[i], 16)
    ring = lambda x, y, n: min(abs(x - y), n - abs(x - y))
    length = ring(nibble(a, 3) * 16 + nibble(a, 2), nibble(b, 3) * 16 + nibble(b, 2), 256)
    total = (a[:2] != b[:2]) + (length if length <= 1 else 12 * length)
    for i in (4, 5):
        q = ring(nibble(a, i), nibble(b, i), 16)
        total += q if q <= 1 else (q - 1) * 12
    for i in range(6, 70):
        for shift in (0, 2):
            d = abs((nibble(a, i) >> shift & 3) - (nibble(b, i) >> shift & 3))
            total += 6 if d == 3 else d
    return total


def mutated(rng, digest, changes):
    text = list(digest)
    for _ in range(changes):
        text[rng.randrange(70)] = rng.choice("0123456789ABCDEF")
    return "".join(text)


def test_tlsh_join_equals_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("0123456789ABCDEF") for _ in range(70)) for _ in range(5)]
    left = sorted({mutated(rng, rng.choice(base), rng.randint(0, 25)) for _ in range(60)})
    right = sorted({mutated(rng, rng.choice(base), rng.randint(0, 25)) for _ in range(40)})
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows] * 2 + [(None,), ("bad",)], "tlsh string")
    # The small bound makes frequent pieces hot.
    for budget, step, bound in ((1, 8, 3), (2, 1, 100_000)):
        got = {tuple(r) for r in fuzzy.tlsh_distances(
            frame(left), frame(right), 50, budget=budget, length_step=step, rows_per_task=bound).collect()}
        want = {(a, b, slow_distance(a, b)) for a in left for b in right if slow_distance(a, b) <= 50}
        assert got == want and want


def test_ssdeep_join_equals_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice(D.B64) for _ in range(64)) for _ in range(3)]

    def make():
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(64)] = rng.choice(D.B64)
        block = rng.choice([1536, 3072])
        return f"{block}:{''.join(text)}:{''.join(text)[:30]}"
    left, right = sorted({make() for _ in range(40)}), sorted({make() for _ in range(30)})

    def score(a, b):
        (ab, a1, a2), (bb, b1, b2) = a.split(":"), b.split(":")
        sides = lambda n, x, y: {int(n): x, int(n) * 2: y}
        one, two = sides(ab, a1, a2), sides(bb, b1, b2)
        best = 0
        for block in one.keys() & two.keys():
            x, y = one[block], two[block]
            if any(x[i:i + 7] in y for i in range(len(x) - 6)):
                edits = len(x) + len(y) - 2 * int(D.common_subsequence(pd.Series([x]), pd.Series([y]))[0])
                best = max(best, 100 - 100 * (edits * 64 // (len(x) + len(y))) // 64)
        return 100 if a == b else best
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "ssdeep string")
    got = {tuple(r) for r in fuzzy.ssdeep_scores(frame(left), frame(right), 90, rows_per_task=5).collect()}
    want = {(a, b, score(a, b)) for a in left for b in right if score(a, b) >= 90}
    assert got == want and want


def test_targets_of_the_locality_join_are_listed_a_few_times(spark, monkeypatch):
    rng = random.Random(11)
    digests = [("".join(rng.choice("0123456789ABCDEF") for _ in range(70)),) for _ in range(30)]
    listed, spread = [], fuzzy.spread_hot_keys

    def counted(left, right, *args):
        listed.append((left.count(), right.count()))
        return spread(left, right, *args)
    monkeypatch.setattr(fuzzy, "spread_hot_keys", counted)
    frame = spark.createDataFrame(digests, "tlsh string")
    got = {tuple(r) for r in fuzzy.tlsh_distances(frame, frame, 50).collect()}
    assert got >= {(d, d, 0) for d, in digests}
    assert listed[0][0] == 30 and listed[0][1] <= 90


def test_numbers_stand_for_signatures_in_the_piecewise_join(spark, monkeypatch):
    """A signature is listed under each of its runs; its text is not, nor is a side broadcast by the size of its file."""
    seen, spread = [], fuzzy.spread_hot_keys

    def watched(left, right, *args):
        seen.extend([set(left.columns), set(right.columns)])
        return spread(left, right, *args)
    monkeypatch.setattr(fuzzy, "spread_hot_keys", watched)
    text = "abcdefghijklmnopqrstuvwxyz"
    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "ssdeep string")
    found = fuzzy.ssdeep_scores(frame(f"1536:{text}:{text[:9]}", "bad", None), frame(f"1536:{text}Z:{text[:9]}", f"3072:{text}:x"), 90)
    assert {tuple(r) for r in found.collect()} == {(f"1536:{text}:{text[:9]}", f"1536:{text}Z:{text[:9]}", 100)}
    assert seen == [{"block", "gram", "a", "size_a"}, {"block", "gram", "b", "size_b"}]


def test_digests_of_far_heads_are_not_compared(spark, monkeypatch):
    """Length and quartile codes alone part most pairs; the others are found as by brute force, over the ends of the codes too."""
    rng = random.Random(13)
    body = "".join(rng.choice("0123456789ABCDEF") for _ in range(64))
    heads = [f"{rng.randrange(4):02X}{rng.choice('01EF')}{rng.choice('0F')}{rng.choice('048CF')}{rng.choice('048CF')}" for _ in range(120)]
    digests = sorted({h + mutated(rng, "0" * 6 + body, rng.randint(0, 6))[6:] for h in heads})
    frame = spark.createDataFrame([(d,) for d in digests], "tlsh string")
    rows = fuzzy._packed(frame, "tlsh").toPandas()
    packed = {n: rows[n].to_numpy().view(np.uint64) if n in fuzzy._PLANES else rows[n].to_numpy() for n in fuzzy._PACKED}
    compared, count = [], np.bitwise_count

    def counted(bits):
        compared.append(bits.size)
        return count(bits)
    monkeypatch.setattr(fuzzy.np, "bitwise_count", counted)
    name = dict(zip(rows["id"], rows["digest"]))
    for bound in (50, 0, 400):
        compared.clear()
        batches = list(fuzzy._close_pairs(packed, fuzzy._by_head(packed), bound))
        got = {(name[a], name[b], d) for batch in batches for a, b, d in zip(*(c.to_pylist() for c in batch.columns))}
        assert got == {(a, b, slow_distance(a, b)) for a in digests for b in digests if slow_distance(a, b) <= bound}
        if bound == 0:
            assert sum(compared) < len(digests) ** 2
