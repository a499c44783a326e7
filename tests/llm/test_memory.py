"""What a Python worker keeps and takes for its work, whatever the texts."""

import tracemalloc

import numpy as np
import public_tokenizers

from egresslens.llm import byte_bpe, language_id, order_minhash, queries
from egresslens.llm.common import HashMemo

MOST = 150_000


def held(memo):
    return len(memo) + len(getattr(memo, "older", ()))


def test_memos_are_bounded():
    ids = HashMemo()
    want = [ids[b"often"], ids[b"0"]]
    for i in range(2 * MOST):
        ids[b"%d" % i]
        ids[b"often"]
    assert held(ids) < MOST
    assert [ids[b"often"], ids[b"0"]] == want


def test_frequent_keys_are_made_once():
    ids, made = HashMemo(), []
    ids.make = lambda token, make=ids.make: made.append(token) or make(token)
    for i in range(2 * MOST):
        ids[b"%d" % i]
        ids[b"often"]
    assert made.count(b"often") == 1


def test_a_codec_is_bounded():
    codec = byte_bpe.Codec(byte_bpe.read_ranks(byte_bpe.read_vocabulary(public_tokenizers.path(queries.VOCABULARY))),
                           public_tokenizers.PATTERN)
    first = codec.encode(" 0x ÿq 1zz" * 50).tolist()
    words = np.random.default_rng(1).integers(ord("a"), ord("z") + 1, (2 * MOST, 6)).astype(np.uint8)
    for start in range(0, len(words), 1000):
        codec.encode(" ".join(bytes(w).decode() for w in words[start:start + 1000]))
    assert held(codec.memo) < MOST and held(codec.vocabulary.fits) < MOST
    assert codec.encode(" 0x ÿq 1zz" * 50).tolist() == first


def test_texts_are_scored_in_small_parts():
    cut = language_id.Cutter()
    texts = [f"some words and the number {'abcdefgh'[i % 8]} " * 20 for i in range(1000)]
    model = language_id.Model({lang: np.unique(language_id.grams(cut.padded(t)), return_counts=True) for lang, t in (("x", texts[0]), ("y", texts[1]))})
    alone = np.concatenate([model.entropies([t], cut)[1] for t in texts[:8]])
    parts, score = [], model.log_probabilities
    model.log_probabilities = lambda keys, order: parts.append(len(keys)) or score(keys, order)
    lengths, entropies = model.entropies(texts, cut)
    assert max(parts) < 110_000 and lengths.sum() > 500_000
    assert (entropies.reshape(-1, 8, 2) == alone).all()


def test_an_alignment_holds_its_band_once():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1000, 20_000).astype(np.uint32)
    b = np.delete(a, rng.integers(0, len(a), 50))
    order_minhash._furthest(a[:100], b[:100], 64)
    tracemalloc.start()
    edits = order_minhash._furthest(a, b, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert edits == order_minhash._banded(a, b, 64)
    assert peak < 2 * (2 * 64 + 1) * 20_000 * 4


def test_classes_start_no_workers_for_empty_tables(spark):
    """Rows handed over by the driver come through Python workers of their own kind, which stay for a while."""
    rows = spark.range(1).selectExpr("encode('n', 'UTF-8') node", "encode('c', 'UTF-8') codes")
    links = order_minhash.Links(rows, order_minhash.Params())
    for df in (links.roots, links.degrees()):
        assert "RDD" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 0
