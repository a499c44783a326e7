"""The whole pipeline against a plain version of its stages."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from egresslens.llm import byte_bpe, order_minhash, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def benchmark_windows(texts):
    out = set()
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        out |= {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    return out


def one_of_each(rows):
    """Smallest id of every connected part of equal texts and of pairs with a shared five-word run and 0.8 alignment."""
    words = [np.array([xxhash.xxh64_intdigest(w) >> 32 for w in r["text"].encode().lower().split()], np.uint32) for r in rows]
    runs = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            limit = order_minhash.edit_limit(0.8, max(len(words[i]), len(words[j])))
            if rows[i]["text"] == rows[j]["text"] or (
                    runs[i] & runs[j] and order_minhash.edits_within(words[i], words[j], limit) is not None):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if find(i) == i]


def encoder():
    data = byte_bpe.read_vocabulary(public_tokenizers.path(queries.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(data))})


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, corpus_pipeline.quality(spark, docs, SF), SF)
    assert kept.columns == COLUMNS
    rows = one_of_each(kept.orderBy("doc_id").collect())
    banned = benchmark_windows(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    widths = {len(w) for w in banned}
    tokens, want = encoder(), {}
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))
        if any(tuple(words[i:i + n]) in banned for n in widths for i in range(len(words) - n + 1)):
            continue
        ids = tokens.encode_ordinary(r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(r["text"].encode()).hexdigest())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    assert len(got) == len(want) > 50


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    blank = docs.limit(3).select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in COLUMNS])
    odd = docs.unionByName(docs).unionByName(blank).withColumns(
        {c: F.lit("clash") for c in ("score", "predicted", "words", "node", "n_tokens", "rejected")})
    out = stage(spark, odd, SF)
    assert out.filter("doc_id is not null").count() > 0
    assert stage(spark, odd.limit(0), SF).count() == 0
