"""String measures and normalisations, all built-in column expressions."""

from pyspark.sql import Column, functions as F


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, which may refer to it many times."""
    return F.transform(F.array(value), use)[0]


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def entropy(col: Column, digits: int = 10) -> Column:
    """Shannon entropy (bits) of the characters; 0 for an empty text."""
    # Each distinct character is cut out once; what the text loses is its count.
    share = lambda ch: (F.length(col) - F.length(F.replace(col, ch))) / F.length(col)
    shares = F.transform(F.array_distinct(F.split(col, "")), share)
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(col.isNull() | (col == ""), F.lit(0.0)).otherwise(F.round(bits, digits) + F.lit(0.0))


def human_bytes(col: Column) -> Column:
    """One decimal and a unit from B to PB, in steps of 1024."""
    value = col.cast("double")
    out = F.format_string("%.1fPB", F.bround(value / 1024**5, 1))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        scaled = value / 1024**power
        out = F.when(scaled < 1024, F.format_string(f"%.1f{unit}", F.bround(scaled, 1))).otherwise(out)
    return F.when(col.isNotNull(), out)


def safe_filename(col: Column) -> Column:
    r"""Drop the characters ``\ / : * ? " < > |``."""
    return F.regexp_replace(col, r'[\\/:*?"<>|]', "")


def dns_name(col: Column) -> Column:
    """Query name without trailing dots; NULL when nothing is left."""
    return blank_to_null(F.regexp_replace(col, r"\.+$", ""))


def labels(name: Column) -> Column:
    return F.filter(F.split(name, r"\."), lambda piece: piece != "")


def label_count(name: Column) -> Column:
    return F.size(labels(name)).cast("bigint")


def label_max(name: Column) -> Column:
    longest = F.array_max(F.transform(labels(name), F.length))
    return F.coalesce(longest, F.lit(0)).cast("bigint")


def label_average(name: Column, digits: int = 10) -> Column:
    pieces = labels(name)
    total = F.length(F.array_join(pieces, ""))
    return F.when(F.size(pieces) > 0, F.round(total / F.size(pieces), digits)).otherwise(0.0)


def has_subdomain(name: Column) -> Column:
    return (F.size(labels(name)) > 2).cast("int")


def subdomain_length(name: Column) -> Column:
    """Characters of all labels but the last two, joined by dots."""
    pieces = labels(name)
    left = F.slice(pieces, 1, F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.length(F.array_join(left, ".")).cast("bigint")


def second_level_label(name: Column) -> Column:
    return F.coalesce(F.try_element_at(labels(name), F.lit(-2)), F.lit(""))


def registered_domain(name: Column) -> Column:
    """The last two labels, or the whole name when it has no dot."""
    return F.substring_index(name, ".", -2)


def count_class(name: Column, char_class: str) -> Column:
    """How many characters fall into a regex character class."""
    return F.length(F.regexp_replace(name, f"[^{char_class}]", "")).cast("bigint")


UPPER, LOWER, DIGIT, SPECIAL = r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"\-_"


def longest_word_length(name: Column) -> Column:
    runs = F.transform(F.split(name, r"[^\p{L}]+"), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0)).cast("bigint")


def as_json(values: Column) -> Column:
    """A set or list as deterministic text."""
    return F.to_json(F.array_sort(values))
