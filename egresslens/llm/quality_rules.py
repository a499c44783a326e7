"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the failed rules as bits of one number
beside the measurements. Policies are versioned sets of rules: applying one, or asking what each of
its rules alone removes, is bit arithmetic over the ledger and never reads a text again.

Words are runs of characters other than blanks and the controls 9 to 13. Repeated words are counted
through hashes of eight-word windows, built by doubling (1, 2, 4, 8 words) in 64 bits.

Defined results: a null or empty text has no words and fails ``few_words``. Repeated rows and ids are
judged row by row. Extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

BETWEEN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"

#: Rule by bit: name and SQL condition of failure over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("shouting", "2 * n_upper > n_letters and n_letters > 0"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
]

#: Versions of the policy: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "word_length", "symbols", "shouting"),
    "v2": tuple(name for name, _ in RULES),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"]


def mask(rules: tuple[str, ...]) -> int:
    known = [name for name, _ in RULES]
    return sum(1 << known.index(name) for name in rules)


def _joined(left: Column, right: Column) -> Column:
    return F.xxhash64(left, right)


def _doubled(hashes: str, step: int) -> Column:
    """Hashes of runs twice as long, from hashes of runs of ``step`` words."""
    size = F.size(hashes) - step
    return F.when(size > 0, F.zip_with(F.slice(hashes, 1, size), F.slice(hashes, step + 1, size), _joined)).otherwise(
        F.array().cast("array<bigint>"))


def _repeated(windows: str) -> Column:
    """Words in windows that occur twice or more: sort (hash, place), keep equal neighbours, add up covers."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rest = F.size(windows) - 1
    pairs = F.filter(F.arrays_zip(F.slice(ranked, 1, rest).alias("a"), F.slice(ranked, 2, rest).alias("b")),
                     lambda p: p["a"]["h"] == p["b"]["h"])
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(
        pairs, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), places)


def _covered(places: str) -> Column:
    """Words under windows of eight that start at the sorted places."""
    rest = F.size(places) - 1
    gaps = F.zip_with(F.slice(places, 1, rest), F.slice(places, 2, rest), lambda a, b: F.least(b - a, F.lit(8)))
    return F.coalesce(F.when(rest > 0, F.aggregate(gaps, F.lit(0), lambda n, gap: n + gap)) + 8, F.lit(0))


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and the measurements of every text."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.array_remove(F.split("text", BETWEEN), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    letters = F.regexp_replace("text", r"\P{L}+", "")
    rows = rows.select(
        "doc_id", "text", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).alias("n_symbols"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("w1"),
        F.length(letters).alias("n_letters"), F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_upper"))
    kept = ["doc_id", *[m for m in MEASURES if m != "n_repeat_words"]]
    rows = rows.select(*kept, _doubled("w1", 1).alias("w2"))
    rows = rows.select(*kept, _doubled("w2", 2).alias("w4"))
    rows = rows.select(*kept, _doubled("w4", 4).alias("w8"))
    rows = rows.select(*kept, _repeated("w8").alias("places"))
    rows = rows.select(*kept, _covered("places").alias("n_repeat_words"))
    return rows.select("doc_id", *[F.col(m).cast("long").alias(m) for m in MEASURES])


def ledger(documents: DataFrame) -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where rule i fails."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(documents).withColumn("fail_bits", total.cast("long"))


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def sole_rule(policy: str) -> Column:
    """The rule of a policy that alone removes a ledger row, else null."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])))
    return F.coalesce(*[F.when(bits == mask((rule,)), F.lit(rule)) for rule in POLICIES[policy]])


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that only it removes, rows kept with and without it.

    The ledger is counted by its bits first, so the rest works on at most 2 ** rules rows.
    """
    rules = POLICIES[policy]
    whole = F.lit(mask(rules))
    counted = book.groupBy(F.col("fail_bits").bitwiseAND(whole).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for r in rules]))
    rows = counted.select("bits", "n", listed.alias("r")).select("bits", "n", "r.rule", "r.bit")

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return rows.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0, "failed"), total(F.col("bits") == F.col("bit"), "removed_alone"),
        total(F.col("bits") == 0, "kept"), total((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), "kept_without"))
