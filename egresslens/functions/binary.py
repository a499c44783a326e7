"""Byte level helpers. Bytes travel as Latin-1 text, which maps all 256 values one to one."""

from pyspark.sql import Column, functions as F

from egresslens.functions.text import let

LATIN1 = "ISO-8859-1"
# A character no Latin-1 text can hold; splitting on it needs no quoting of the separator.
MARK = "Ā"


def to_latin1(data: Column) -> Column:
    return F.decode(data, LATIN1)


def from_latin1(text: Column) -> Column:
    return F.encode(text, LATIN1)


def lossy_utf8(data: Column) -> Column:
    """Decode UTF-8 and drop the invalid bytes."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))


def latin1_to_utf8(text: Column) -> Column:
    return lossy_utf8(from_latin1(text))


def utf8_to_latin1(text: Column) -> Column:
    return to_latin1(F.encode(text, "UTF-8"))


def split_literal(text: Column, separator: Column) -> Column:
    """Split Latin-1 text on a separator taken literally."""
    return F.split(F.replace(text, separator, F.lit(MARK)), MARK)


def non_empty(data: Column) -> Column:
    return let(data, lambda d: F.when(F.octet_length(d) > 0, d))


def decode_hex(col: Column) -> Column:
    """Hex text with optional colons, blanks and 0x prefix; an odd last digit is dropped."""
    digits = F.regexp_replace(F.regexp_replace(col, r"[:\s]", ""), "^0[xX]", "")
    even = let(digits, lambda d: F.substring(d, F.lit(1), F.length(d) - F.length(d) % 2))
    data = let(even, lambda e: F.when(e.rlike("^[0-9a-fA-F]*$"), F.unhex(e)))
    return F.when(F.length(col) > 0, data)


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def content_sha256(data: Column) -> Column:
    """Digest of inventory content: NULL for missing or empty content."""
    return F.sha2(non_empty(data), 256)


def content_md5(data: Column) -> Column:
    return F.md5(non_empty(data))


def ordered_concat(blocks: Column) -> Column:
    """Join ``array<struct<block,data>>`` in block order."""
    in_order = F.transform(F.array_sort(blocks), lambda b: to_latin1(b["data"]))
    return from_latin1(F.array_join(in_order, ""))
