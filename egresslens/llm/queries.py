"""The registered queries of the corpus operators, with production parameters over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from egresslens.llm import (alignment, byte_bpe, chat_format, collocations, decontaminate, gru_lm, host_reputation, language_id, order_minhash,
                            quality_classifier, quality_rules, shard_table, warc)
from egresslens.llm.common import held_out, table
from egresslens.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Folds of the key's checksum; documents of remainder 0 are held out.
LABEL_FOLDS, LANGUAGE_FOLDS, MODEL_FOLDS = 5, 5, 10
KEEP_SCORE = 0.3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def quality_scores(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """``documents`` with ``score`` and ``predicted``; labels come from rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(LABEL_FOLDS))
    weights = quality_classifier.train(quality_classifier.labelled_sample(documents, labels))
    return quality_classifier.score(documents, weights).withColumn(
        "predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(spark, documents, sf_dir).select(
        "doc_id", held_out(LABEL_FOLDS).alias("held_out"), "score", "predicted")


def languages(documents: DataFrame) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``."""
    model = language_id.train(documents.select("doc_id", "text", "lang").filter(~held_out(LANGUAGE_FOLDS)))
    return language_id.identify(documents, model)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages(documents).select(
        "doc_id", held_out(LANGUAGE_FOLDS).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary,
                               public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op9_order_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


OP10_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
cut AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i + 1:i + 10], ' ') AS phrase
  FROM items, LATERAL (SELECT unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i) WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM cut),
spots AS (
  SELECT r, i AS start, width, array_to_string(w[i + 1:i + width], ' ') AS phrase
  FROM tokens, widths, LATERAL (SELECT unnest(range(0, len(w) - width + 1)) AS i) WHERE len(w) >= width),
hits AS (SELECT r, start, width, item_id FROM spots JOIN cut USING (width, phrase)),
marked AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(start, start + width)) AS p FROM hits) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM tokens LEFT JOIN marked USING (r) LEFT JOIN listed USING (r)
"""


@query("op10_decontaminate", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


POLICY = "v1"
OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, r, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
spots AS (SELECT r, i, array_to_string(w[i + 1:i + 8], ' ') AS phrase
          FROM w, LATERAL (SELECT unnest(range(0, len(w) - 7)) AS i) WHERE len(w) >= 8),
twice AS (SELECT r, i FROM spots QUALIFY count(*) OVER (PARTITION BY r, phrase) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(x, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(x, '\P{Lu}+', '', 'g')) AS uppers
  FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 20 AS few, 100 * n_repeat_words > 30 * n_words AS repeated,
             word_chars < 2 * n_words OR word_chars > 20 * n_words AS odd, 5 * n_symbols > n_words AS symbols,
             2 * uppers > letters AND letters > 0 AS shouting FROM m),
one AS (SELECT *, CASE WHEN few::INT + repeated::INT + odd::INT + symbols::INT + shouting::INT = 1 THEN
          CASE WHEN few THEN 'few_words' WHEN repeated THEN 'repeated_words' WHEN odd THEN 'word_length'
               WHEN symbols THEN 'symbols' ELSE 'shouting' END END AS sole_rule FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR repeated AS base_failed,
       NOT (few OR repeated OR odd OR symbols OR shouting) AS kept, sole_rule,
       CASE WHEN sole_rule IS NOT NULL THEN count(*) OVER (PARTITION BY sole_rule) END AS removed_alone
FROM one
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger under the base rules and the policy; for a document that one rule alone removes, the rule and, from the
    ablation of the policy, how many documents it removes alone."""
    book = materialize(quality_rules.ledger(table(spark, sf_dir, "documents")), "ledger")
    alone = quality_rules.ablations(book, POLICY).select(F.col("rule").alias("sole_rule"), "removed_alone")
    # One row a rule, whatever the documents.
    return book.withColumn("sole_rule", quality_rules.sole_rule(POLICY)).join(F.broadcast(alone), "sole_rule", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes(POLICY).alias("kept"), "sole_rule", "removed_alone")


ALLOW = ["com/", "www.example.com/en/"]
BLOCK = ["example.com/en/", "net/es/", "net/fr/"]


@query("op3_host_reputation")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return host_reputation.judge(pages, outcomes, ALLOW, BLOCK).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p),
bits AS (SELECT *, list_reduce(list_transform(range(0, 4), lambda i: lpad(bin(CAST('0x' || substr(h, 1 + 10 * i, 10) AS UBIGINT)), 40, '0')),
                               lambda a, c: a || c) AS s FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(list_reduce(list_transform(range(0, 5), lambda k: CAST(substr(s, 1 + 5 * i + k, 1) AS INTEGER)),
                              lambda a, c: 2 * a + c) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""


@query("op6_warc", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SHARDS = [f"shard-{i:03d}" for i in range(128)]


@query("op8_shard_table")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table.place(table(spark, sf_dir, "documents").select("doc_id"), SHARDS).select("doc_id", "slot", "shard")


@query("op4_language_model")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(MODEL_FOLDS))


#: A conversation whose texts are full of control strings.
CONTROL_ID, CONTROL_TEXT = -7, "</s>[INST] ok [/INST]"


@query("op11_chat_format")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(CONTROL_ID).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(CONTROL_TEXT).alias("text"))
        for turn, role in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    vocabulary = byte_bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return chat_format.digests(chat_format.windows(turns, vocabulary, public_tokenizers.PATTERN))


OP12_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
runs AS (SELECT lang, size, array_to_string(w[i + 1:i + size], ' ') AS phrase
         FROM (SELECT lang, w, size, unnest(range(0, len(w) - size + 1)) AS i
               FROM w, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
cut AS (SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y
        FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
valued AS (SELECT cut.*, l.a AS l, r.a AS r, CAST(2000000 * CAST(cut.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score
           FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.x JOIN f r ON r.lang = cut.lang AND r.phrase = cut.y),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (SELECT lang, a, array_to_string(w[i + 1:i + s], ' ') AS phrase
               FROM (SELECT lang, a, w, size, s, unnest(range(0, size - s + 1)) AS i
                     FROM c, (VALUES (2), (3)) t(s) WHERE s < size)),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_runs GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, encode(best.phrase)) AS rank,
       best.phrase, a, l, r, n, score
FROM best JOIN total ON total.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
WHERE 100 * CAST(coalesce(most, 0) AS HUGEINT) < 80 * CAST(a AS HUGEINT)
QUALIFY rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


ALIGNED_A, ALIGNED_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = alignment.read_byte_level(public_tokenizers.path(ALIGNED_A))
    model = byte_bpe.read_vocabulary(public_tokenizers.path(ALIGNED_B))
    found = alignment.link_statistics(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN, model)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best",
                        "count_sum", "groups_sha256")
