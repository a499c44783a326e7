"""Corpus pipeline: quality, language, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from egresslens.llm import byte_bpe, decontaminate, order_minhash, queries
from egresslens.llm.common import table
from egresslens.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text is judged as an empty one; rows of one id are judged each by its own text, so repeated rows share
    their fate. A score on the bound is accepted. No rows give no rows; extra columns are left behind.
    """
    return queries.quality_scores(spark, docs.select(*COLUMNS), sf_dir).filter("predicted = 1").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with entropy as usual for it.

    Null texts and texts without a letter go. A tie goes to the language first by name. Repeated rows share their fate;
    without a row whose language is known all rows go, and no rows give no rows.
    """
    return queries.languages(docs.select(*COLUMNS)).filter(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    The smallest doc_id stays, of repeated rows one. Rows without a word (null texts too) stand alone and all stay; a
    class without any id keeps one row of its smallest text. No rows give no rows.
    """
    return order_minhash.survivors(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts hold none and stay. Repeated rows share their fate, null ids are told apart by their texts. An empty
    benchmark removes nothing, and no rows give no rows.
    """
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes decoded from them.

    A null text is encoded as an empty one: no tokens. Every row gives a row, repeated ones too.
    """
    vocabulary = byte_bpe.read_vocabulary(public_tokenizers.path(queries.VOCABULARY))
    return byte_bpe.round_trip(docs.select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", tokens),
]

#: No stage but decontamination can be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
