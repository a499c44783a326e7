"""File type from name, size and the first bytes."""

from functools import reduce

from pyspark.sql import Column, functions as F

from egresslens import constants as C


#: Bytes that the longest signature looks at.
HEADER_BYTES = max(len(prefix) for prefix, _ in C.SIGNATURES) // 2


def _starts_with(header: Column, hex_prefix: str) -> Column:
    prefix = F.unhex(F.lit(hex_prefix))
    return F.substring(header, 1, len(hex_prefix) // 2) == prefix


def signature_type(data: Column) -> Column:
    """Type by signature only; unknown content is an octet stream."""
    header = F.substring(data, 1, HEADER_BYTES)
    return reduce(
        lambda rest, rule: F.when(_starts_with(header, rule[0]), rule[1]).otherwise(rest),
        reversed(C.SIGNATURES),
        F.lit(C.TYPE_UNKNOWN),
    )


def detect_type(name: Column, size: Column, data: Column) -> Column:
    """Empty, unreadable, file-system metadata, then signatures."""
    meta = reduce(lambda a, b: a | b, [F.contains(name, F.lit(n)) for n in C.NTFS_META_NAMES])
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, C.TYPE_EMPTY)
        .when(data.isNull() | (F.octet_length(data) == 0), C.TYPE_UNKNOWN)
        .when(F.coalesce(meta, F.lit(False)), C.TYPE_NTFS_META)
        .when(_starts_with(data, "4D5A"), C.TYPE_EXECUTABLE)
        .otherwise(signature_type(data))
    )
