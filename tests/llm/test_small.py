"""Corpus operators against plain versions on small rows: nulls, empty and long texts, ties, repeats."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from egresslens.llm import (byte_bpe, decontaminate, gru_lm, host_reputation, language_id, order_minhash,
                            quality_classifier, quality_rules, shard_table, warc)

SCHEMA = "doc_id long, text string, lang string, score string, words string"
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
TEXTS = [None, "", " \n\t", "one", "a b c d e f g h a b c d e f g h", "x\nx\n\ny", "ÀÉ ## É z", LONG]


def rows(spark, texts, lang="en"):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", "w") for i, t in enumerate(texts)], SCHEMA)


def split(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def test_quality_measures(spark):
    got = {r["doc_id"]: r for r in quality_rules.ledger(rows(spark, [*TEXTS, *TEXTS])).collect()}
    assert len(got) == 2 * len(TEXTS)
    for i, text in enumerate([*TEXTS, *TEXTS]):
        w = split(text)
        windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        seen = {}
        for k, window in enumerate(windows):
            seen.setdefault(window, []).append(k)
        covered = {p for ks in seen.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (
            len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
    assert quality_rules.ledger(rows(spark, [])).count() == 0


def test_ablations(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (3,), (8,)], "fail_bits long")
    got = {r["rule"]: (r["failed"], r["removed_alone"], r["kept"], r["kept_without"])
           for r in quality_rules.ablations(book, "base").collect()}
    assert got == {"few_words": (3, 2, 2, 4), "repeated_words": (1, 0, 2, 2)}


def test_quality_classifier(spark):
    good, bad = "the cat sat on the mat", "### cat *** mat ### $$$ sat"
    labelled = spark.createDataFrame([(i, good if i % 2 else bad, i % 2) for i in range(60)], "doc_id long, text string, label int")
    weights = quality_classifier.train(labelled)
    got = [r["score"] for r in quality_classifier.score(rows(spark, [good, bad, None, LONG]), weights)
           .orderBy("doc_id").collect()]
    assert got[0] > 0.9 and got[1] < 0.1 and all(0 <= x <= 1 for x in got)
    none = quality_classifier.train(labelled.limit(0))
    assert quality_classifier.score(rows(spark, [good]), none).first()["score"] == 0.5


def test_language_id(spark):
    words = {"aa": "ka lo mi ", "bb": "zür xen qöp "}
    docs = spark.createDataFrame([(i, words[k] * (5 + i % 7), k) for i in range(80) for k in words], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = language_id.identify(rows(spark, ["ka mi lo lo", "XEN ZÜR qöp", None, "12 !?", "\U0001F600", LONG]), model)
    got = [(r["lang_pred"], r["score"]) for r in got.orderBy("doc_id").collect()]
    assert [g[0] for g in got[:5]] == ["aa", "bb", "und", "und", "und"] and got[5][0] in words
    assert all(0 <= s <= 1 for _, s in got) and got[2][1] == 0
    empty = language_id.train(docs.limit(0))
    assert language_id.identify(rows(spark, ["ka"]), empty).first()["lang_pred"] == "und"


def test_language_models_are_distributions():
    cut = language_id.Cutter()
    keys, counts = np.unique(language_id.grams(cut.padded("abab ba abba " * 3)), return_counts=True)
    model = language_id.Model({"x": (keys, counts)})
    units = [np.uint64(ord(c)) for c in "ab "]
    for context in ("aba", "zzz", " a"):
        head = sum(np.uint64(ord(c)) << np.uint64(16 * i) for i, c in enumerate(reversed(context), 1)) & np.uint64(2 ** 64 - 1)
        known = np.exp(model.log_probabilities(np.array([head | u for u in units]), 4)).sum()
        other = np.exp(model.log_probabilities(np.array([head | np.uint64(ord("q"))]), 4)).sum()
        assert known + other == pytest.approx(1, abs=1e-4)  # all other units share the place of one


def test_byte_bpe_matches_tiktoken(spark):
    data = byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(data))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(5)
    texts = [*TEXTS, "a" * 5000, "thth" * 3000, "<|endoftext|>",
             *("".join(draw.choice("ab  th'sé日\n\t\x1c\x8512!?") for _ in range(60)) for _ in range(60))]
    docs = rows(spark, texts)
    encoded = byte_bpe.decode(byte_bpe.encode(docs, data, public_tokenizers.PATTERN), data)
    digests = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, data, public_tokenizers.PATTERN).collect()}
    for r in encoded.collect():
        want = reference.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_alignment_is_edit_distance():
    draw = random.Random(3)

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    for _ in range(300):
        a = [draw.randrange(6) for _ in range(draw.randrange(1, 25))]
        b = [draw.randrange(6) if draw.random() < 0.2 else x for x in a][draw.randrange(3):] or [1]
        x, y, d = np.array(a, np.uint32), np.array(b, np.uint32), distance(a, b)
        limit = draw.randrange(10)
        assert order_minhash.edits_within(x, y, limit) == (d if d <= limit else None)
        for width in (2, 9):
            for method in (order_minhash._banded, order_minhash._furthest):
                got = method(x, y, width)
                assert got == d if d <= width else got > width


def test_near_duplicates(spark):
    draw = random.Random(9)
    base = [[f"v{draw.randrange(10 ** 6)}" for _ in range(120)] for _ in range(30)]
    texts, family = [], []
    for n, words in enumerate(base):
        for copy in range(30 if n == 0 else 1 + n % 3):
            mine = list(words)
            for _ in range(0 if copy == 0 else 2):
                mine[draw.randrange(120)] = f"u{draw.randrange(10 ** 6)}"
            texts.append(" ".join(mine))
            family.append(n)
    texts += [texts[0], texts[0].upper(), None, "", "short one", "short one", LONG, LONG + " end"]
    family += [0, 0, "null", "empty", "short", "short", "long", "long"]
    got = {r["doc_id"]: r for r in order_minhash.classes(rows(spark, texts)).collect()}
    first = {}
    for i, f in enumerate(family):
        assert got[i]["class_id"] == first.setdefault(f, i) and got[i]["kept"] == (first[f] == i), (i, f)
    doubled = rows(spark, texts).union(rows(spark, texts))
    assert order_minhash.survivors(doubled).filter("text like '%v%'").count() == len(base)
    assert order_minhash.classes(rows(spark, [])).count() == 0


def test_near_copies_inside_a_crowd(spark):
    """Pairs of near copies among texts that share a long passage; every pair of similarity 0.8 must end in one class."""
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(300)]
    texts = []
    for n in range(300):
        one = passage + [f"v{draw.randrange(10 ** 7)}" for _ in range(100)]
        two = list(one)
        for at in draw.sample(range(400), 8):
            two[at] = f"u{draw.randrange(10 ** 7)}"
        texts += [one, two]
    runs = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = [n for n in range(0, len(texts), 2) if len(runs[n] & runs[n + 1]) >= 0.8 * len(runs[n] | runs[n + 1])]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(rows(spark, [" ".join(t) for t in texts])).collect()}
    missed = [n for n in near if got[n] != got[n + 1]]
    assert len(near) > 200 and not missed, f"{len(missed)} of {len(near)} pairs missed"
    assert len(set(got.values())) >= len(texts) // 2


def test_texts_of_frequent_runs_only(spark):
    """Texts of lines that many texts hold: no rare run tells them apart, and the first of a length may be no link."""
    draw = random.Random(8)
    lines = [" ".join(f"l{i}w{k}" for k in range(10)) for i in range(60)]
    texts = []
    for n in range(60):
        one = draw.sample(lines, 20)
        two = list(one)
        two[draw.randrange(20)] = draw.choice(lines)
        texts += [" ".join(one), " ".join(two)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(rows(spark, texts)).collect()}
    assert all(got[n] == got[n + 1] for n in range(0, len(texts), 2))


def test_decontamination(spark):
    passage = [f"p{i}" for i in range(14)]
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, "Short ITEM here"), (None, "no id item"), (3, None), (3, "")],
                                  "item_id long, text string")
    texts = ["x " + " ".join(passage).upper() + " y", " ".join(passage[:9]), "a short-item, here; b short item here", None, "",
             "no id item", " ".join(passage[2:12]) + " z " + " ".join(passage[2:12])]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"]))
           for r in decontaminate.contamination(rows(spark, texts), bench).collect()}
    assert got == {0: (16, 14, [1]), 1: (9, 0, []), 2: (8, 6, [2]), 3: (0, 0, []), 4: (0, 0, []), 5: (3, 3, []), 6: (21, 20, [1])}
    assert {r["doc_id"] for r in decontaminate.clean(rows(spark, texts), bench).collect()} == {1, 3, 4}
    cut, _ = decontaminate.windows(bench)
    moved = rows(spark, [" ".join(passage[:5] + ["q"] + passage[5:10])])
    terms = decontaminate.index_terms(moved.union(rows(spark, texts)), cut)
    index = decontaminate.build_index(moved, terms)
    assert decontaminate.phrases(index, terms).count() == 0 and decontaminate.proximity(index, terms, 2).count() > 0


def test_host_reputation(spark):
    urls = ["HTTP://A.Example.COM/x?y", "http://example.com/en/1", "https://www.example.com/en/2#z", "ftp://b.net/es/", None, "nothing",
            "http://bad.org/1", "http://bad.org/2", "http://fine.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(6, 0), (7, 0), (8, 1), (None, 1), (0, None)], "page_id long, good int")
    got = {r["page_id"]: r for r in host_reputation.judge(
        pages, outcomes, ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/"]).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(4)] == [
        ("a.example.com", "/x", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/2", "www.example.com/en/", "allow"), ("b.net", "/es/", "net/es/", "block")]
    assert (got[4]["host"], got[5]["host"], got[4]["rule"]) == ("", "", None)
    assert got[6]["mean"] < got[8]["mean"] and len(got) == len(urls)
    assert host_reputation.judge(pages.limit(0), outcomes, [], []).count() == 0


def test_warc_round_trip(spark, tmp_path):
    htmls = ["<p>é</p>", None, "", "<p>é</p>", "x" * 600_000, "WARC/1.1\r\n\r\n"]
    pages = spark.createDataFrame([(i + 10, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read(warc.write(pages)).collect()}
    for i, h in enumerate(htmls):
        first = 10 + next(k for k, x in enumerate(htmls) if (x or "") == (h or ""))
        r = got[i + 10]
        assert r["payload_bytes"] == len((h or "").encode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i + 10 else ("revisit", first))
    damaged = bytearray(warc.record(1, None, b"payload", hashlib.sha1(b"payload").hexdigest(), 7, None))
    damaged[-6] ^= 1
    with pytest.raises(warc.Damaged):
        warc.read_record(iter([bytes(damaged)]))
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_shard_table(spark):
    names = [f"s{i}" for i in range(7)]
    table = shard_table.fill(names, 1009)
    sizes = [table.count(n) for n in names]
    assert max(sizes) - min(sizes) <= 1
    without = shard_table.fill(names[1:], 1009)
    moved = sum(a != b for a, b in zip(table, without) if a != "s0")
    assert moved < 0.25 * 1009
    docs = rows(spark, ["a"] * 50).union(rows(spark, [None]).withColumn("doc_id", F.lit(None).cast("long")))
    placed = shard_table.place(docs, names, slots=1009).collect()
    assert len(placed) == 51 and all(table[r["slot"]] == r["shard"] for r in placed)
    with pytest.raises(ValueError):
        shard_table.fill(names, 1000)


def test_language_model(spark):
    params = gru_lm.Params(heads=8, width=4, tails=4, known=12, epochs=30)
    draw = random.Random(2)
    a, b = ["ka", "lo", "mi", "ta"], ["zur", "xen", "qop", "vul"]
    texts = [" ".join(draw.choice(a if i % 2 else b) for _ in range(40)) + f" rare{i}" for i in range(60)] + [None, ""]
    docs = rows(spark, [*texts, LONG])
    held = F.col("doc_id") % 10 == 0
    got = {r["doc_id"]: r for r in gru_lm.language_model_scores(docs, held, params).collect()}
    learned = [t for i, t in enumerate([*texts, LONG]) if i % 10]
    counts = {}
    for t in learned:
        for w in [*split(t), ""]:
            counts[w.lower()] = counts.get(w.lower(), 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    for i, t in enumerate([*texts, LONG]):
        words = [w.lower() for w in [*split(t), ""]]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (
            len(words), sum(w in counts for w in words), total)
        assert got[i]["base_score"] == pytest.approx(sum(
            np.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for w in words))
    assert sum(got[i]["score"] for i in (10, 20, 30)) > sum(got[i]["base_score"] for i in (10, 20, 30))
    lex_free = gru_lm.language_model_scores(docs.limit(2), F.lit(True), params).collect()
    assert all(r["n_known"] == 0 for r in lex_free)


def test_language_model_learns_from_every_text(spark):
    """Whichever tenth of the training texts changes, the network does too, while counts stay the same."""
    params = gru_lm.Params(heads=8, width=4, tails=4, known=12, lanes=8, epochs=1)
    docs = spark.range(1500).selectExpr("id AS doc_id", "concat_ws(' ', 'ka lo mi', id % 3, 'ta') AS text")
    lex = gru_lm.lexicon(gru_lm.count_words(docs, params), params)
    weights = gru_lm.train(docs, lex, params)
    tenth = lambda text: F.floor(F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30)) / (1 << 30) * 10)
    # A changed text keeps its place in the order of the draw, so only what is learned from it can differ.
    moved = docs.select("doc_id", F.explode(F.expr("transform(sequence(3, 80), k -> trim(repeat('ta ', k)))")).alias("other"), "text")
    moved = moved.filter(tenth("other") == tenth("text")).groupBy("doc_id").agg(F.min("other").alias("other")).cache()
    for part in (1, 9):
        changed = docs.join(moved, "doc_id", "left").select("doc_id", F.when(
            tenth("text") == part, F.coalesce("other", "text")).otherwise(F.col("text")).alias("text"))
        assert not np.array_equal(weights, gru_lm.train(changed, lex, params)), part
