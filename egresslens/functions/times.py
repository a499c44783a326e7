"""Timestamp text, parsing and cyclic encoding."""

import math

from pyspark.sql import Column, functions as F

from egresslens import constants as C


def millis_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def parse_timestamp(text: Column) -> Column:
    """Text with or without a fraction; anything else is an error."""
    return F.when(
        F.contains(text, F.lit(".")), F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]")
    ).otherwise(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"))


def cyclic_columns(ts: Column) -> dict[str, Column]:
    """Sine and cosine of each calendar part over its period."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    parts = {
        "hour": (F.hour(ts), 24),
        "minute": (F.minute(ts), 60),
        "second": (F.second(ts), 60),
        "ms": (micros, 1_000_000),
        "dow": (F.weekday(ts), 7),
        "month": (F.month(ts) - 1, 12),
    }
    out = {}
    for name, (value, period) in parts.items():
        angle = F.lit(2 * math.pi) * value / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def encode_cyclic(df, timestamp_col: str = "timestamp"):
    """Replace the timestamp column by its cyclic columns."""
    kind = dict(df.dtypes)[timestamp_col]
    ts = F.col(timestamp_col).cast("timestamp") if kind.startswith("timestamp") else parse_timestamp(F.col(timestamp_col))
    return df.withColumns(cyclic_columns(ts)).drop(timestamp_col)


def syslog_stamp(line: Column) -> Column:
    """First syslog stamp as ISO text in the year 1900; raw text when it is no date."""
    raw = F.nullif(F.regexp_extract(line, C.RE_SYSLOG_STAMP, 1), F.lit(""))
    spaced = F.concat(F.lit("1900 "), F.regexp_replace(raw, r"\s+", " "))
    parsed = F.try_to_timestamp(spaced, F.lit("yyyy MMM d HH:mm:ss"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), raw)
