"""Benchmark decontamination with a positional inverted index.

Benchmark items are cut into windows of ten words. For every window the three terms that are rarest
in the training texts are its index terms. The index holds the postings of the index terms, one row
per occurrence with document, position and, for terms that are the rarest of a window, the words
around. A search starts from the rarest term: its postings, moved back by the term's place in the
window, are possible starts; they are intersected with the moved postings of the second and the third
term, and what stays is compared with the whole window. ``proximity`` asks the same lists for the
terms near each other instead.

The index is rows, never lists, so a frequent term is many rows in many tasks. Only benchmark terms
are looked up in the texts; Spark broadcasts that list when its written size allows.

Defined results: null and empty texts have no words and no hits; an item without words has no
window; windows of items without an id mark words and are in no item list. Documents are told apart
by doc_id (an integer or null) and text; repeated rows get the same row each. Other columns play no part.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from egresslens.session import materialize

WINDOW = 10
INDEX_TERMS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands behind the last word of every document; no word is empty.
END = ""
NO_ID = -(1 << 63)


def words(column: str = "text") -> Column:
    """Lower-cased words: digits, a to z and whatever lies beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                            F.xxhash64("text").alias("version"), words().alias("words"))


def windows(benchmark: DataFrame, length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, words, width) of distinct windows and (window, item_id) of the items that hold them."""
    items = benchmark.select("item_id", words().alias("words")).filter(F.size("words") > 0)
    cut = items.select("item_id", F.explode(F.expr(
        f"transform(sequence(0, greatest(size(words) - {length}, 0)), i -> slice(words, i + 1, {length}))")).alias("words"))
    cut = materialize(cut.distinct(), "benchmark-windows")
    distinct = materialize(cut.select("words").distinct().select(
        F.monotonically_increasing_id().alias("window"), "words", F.size("words").alias("width")), "windows")
    return distinct, materialize(cut.filter("item_id is not null").join(distinct, "words").select("window", "item_id"),
                                 "window-items")


def index_terms(documents: DataFrame, cut: DataFrame, terms: int = INDEX_TERMS) -> DataFrame:
    """(term, window, place, rank, width, words): the rarest terms of each window that can occur at all.

    A window with a term that no document holds is left out.
    """
    places = cut.select("window", F.posexplode("words").alias("place", "term")).groupBy("window", "term").agg(
        F.min("place").alias("place"))
    wanted = materialize(places.select("term").distinct(), "benchmark-terms")
    counts = (_documents(documents).select(F.explode("words").alias("term")).join(wanted, "term")
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    ranked = places.join(materialize(counts, "term-counts"), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_rarity = Window.partitionBy("window").orderBy("n", "place")
    ranked = (ranked.withColumn("least", F.min("n").over(Window.partitionBy("window"))).filter("least > 0")
              .withColumn("rank", F.row_number().over(by_rarity)).filter(F.col("rank") <= terms))
    last = F.max("rank").over(Window.partitionBy("window"))
    return materialize(ranked.withColumn("ranks", last).join(cut, "window").select(
        "term", "window", "place", "rank", "ranks", "width", F.when(F.col("rank") == 1, F.col("words")).alias("words")),
        "index-terms")


def build_index(documents: DataFrame, terms: DataFrame, length: int = WINDOW) -> DataFrame:
    """Postings (id, version, n_words, term, position, from, around) and one END posting per document."""
    listed = terms.groupBy("term").agg((F.min("rank") == 1).alias("rarest")).union(
        terms.sparkSession.range(1).select(F.lit(END), F.lit(False)))
    listed = materialize(listed, "listed-terms")
    start = F.greatest(F.col("position") - (length - 1), F.lit(0))
    rows = _documents(documents).select(
        "id", "version", "words", F.posexplode(F.array_append("words", F.lit(END))).alias("position", "term"))
    return materialize(rows.join(listed, "term").select(
        "id", "version", F.size("words").alias("n_words"), "term", "position", start.alias("from"),
        F.when(F.col("rarest"), F.slice("words", start + 1, 2 * length - 1)).alias("around")), "postings")


def _starts(index: DataFrame, terms: DataFrame, rank: int) -> DataFrame:
    """Possible starts of windows by their term of this rank."""
    mine = terms.filter(F.col("rank") == rank).withColumnRenamed("words", "phrase")
    return index.filter(F.col("term") != END).join(mine, "term").withColumn("start", F.col("position") - F.col("place"))


def phrases(index: DataFrame, terms: DataFrame, most: int = INDEX_TERMS) -> DataFrame:
    """Exact occurrences (id, version, window, start, end) of windows."""
    found = _starts(index, terms, 1).filter("start >= 0")
    columns = ["id", "version", "window", "start"]
    for rank in range(2, most + 1):
        other = _starts(index, terms, rank).select(*columns)
        needed = found.filter(F.col("ranks") >= rank).join(other, columns, "left_semi")
        found = needed.unionByName(found.filter(F.col("ranks") < rank))
    same = F.slice("around", F.col("start") - F.col("from") + 1, F.col("width")) == F.col("phrase")
    return found.filter(same).select(*columns, (F.col("start") + F.col("width")).alias("end"))


def proximity(index: DataFrame, terms: DataFrame, slack: int) -> DataFrame:
    """(id, version, window, start): places where the index terms of a window lie as in the window, each
    moved by at most ``slack`` words; exact phrases included."""
    found = _starts(index, terms, 1).select("id", "version", "window", "start", "ranks")
    for rank in (2, 3):
        other = _starts(index, terms, rank).select("id", "version", "window", F.col("start").alias("other"))
        # a cell of the width of the slack and its two neighbours hold every start in reach
        near = other.withColumn("cell", F.explode(F.array(*[
            F.floor(F.col("other") / (slack + 1)) + d for d in (-1, 0, 1)])))
        celled = found.withColumn("cell", F.floor(F.col("start") / (slack + 1)))
        keys = ["id", "version", "window", "cell"]
        joined = celled.filter(F.col("ranks") >= rank).alias("f").join(
            near.alias("o"), (F.abs(F.col("f.start") - F.col("o.other")) <= slack)
            & F.expr(" and ".join(f"f.{k} = o.{k}" for k in keys)), "left_semi").drop("cell")
        found = joined.unionByName(found.filter(F.col("ranks") < rank))
    return found.select("id", "version", "window", "start").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: id, version, n_words, n_hit, items (ids of items with an occurring window)."""
    cut, holders = windows(benchmark)
    terms = index_terms(documents, cut)
    index = build_index(documents, terms)
    found = materialize(phrases(index, terms), "phrases")
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda seen, span: F.struct(
            (seen["n"] + F.greatest(F.lit(0), span["end"] - F.greatest(seen["upto"], span["start"]))).alias("n"),
            F.greatest(seen["upto"], span["end"]).alias("upto")),
        lambda seen: seen["n"])
    marked = (found.groupBy("id", "version").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
              .select("id", "version", covered.alias("n_hit")))
    listed = (found.select("id", "version", "window").distinct().join(holders, "window")
              .groupBy("id", "version").agg(F.collect_set("item_id").alias("items")))
    return (index.filter(F.col("term") == END).select("id", "version", "n_words")
            .join(marked, ["id", "version"], "left").join(listed, ["id", "version"], "left")
            .select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "version",
                    F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<bigint>")).alias("items")))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no window occurs."""
    hit = (contamination(documents, benchmark).filter("n_hit > 0")
           .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("version").alias("__version")).distinct())
    hit = materialize(hit, "contaminated")
    keyed = documents.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)),
                                   "__version": F.xxhash64("text")})
    return keyed.join(hit, ["__id", "__version"], "left_anti").select(*documents.columns)
