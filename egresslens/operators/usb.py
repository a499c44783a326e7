"""USB device history from system logs and extracted registry keys."""

from pyspark.sql import Column, DataFrame, functions as F

from egresslens import constants as C
from egresslens.functions.times import syslog_stamp
from egresslens.operators.filters import usb_lines
from egresslens.operators.ordered import DEFAULT_WIDTH, running
from egresslens.schemas import USB_EVENT, conform

FIELDS = {"idvendor": "vendor", "idproduct": "product", "manufacturer": "manufacturer",
          "product": "description", "serialnumber": "serial"}


def usb_pairs(line: Column) -> dict[str, Column]:
    """Device fields of a line; the last of repeated keys counts."""
    found = F.regexp_extract_all(line, F.lit(C.RE_USB_PAIR), F.lit(0))
    def value(key: str) -> Column:
        hits = F.filter(found, lambda p: F.lower(F.substring_index(p, "=", 1)) == key)
        last = F.try_element_at(hits, F.lit(-1))
        return F.substring(last, F.instr(last, "=") + 1, F.length(last))
    return {name: value(key) for key, name in FIELDS.items()}


def linux_usb_events(lines: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Device records of log lines ``(file, line_no, line)``.

    Fields gather over lines; a line that gives vendor or product emits the record and starts a
    new one, so whatever follows it belongs to the next record.
    """
    parsed = usb_lines(lines).select(
        "file", "line_no", syslog_stamp(F.col("line")).alias("timestamp"),
        *[c.alias(n) for n, c in usb_pairs(F.col("line")).items()])
    emits = F.col("vendor").isNotNull() | F.col("product").isNotNull()
    grouped = running(parsed.withColumn("emits", emits), ["file"], ["line_no"], inclusive=False,
                      sums={"record": F.when(F.col("emits"), 1).otherwise(0).cast("bigint")}, width=width)
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias(name)
    records = grouped.groupBy("file", "record").agg(
        F.bool_or("emits").alias("complete"), F.max("line_no").alias("line_no"),
        *[last(name) for name in ["timestamp", *FIELDS.values()]])
    return records.filter("complete").drop("complete", "record")


def windows_usb_events(keys: DataFrame) -> DataFrame:
    """Device records of already extracted registry keys ``(device_name, instance, values)``."""
    return conform(keys, USB_EVENT, kind=F.lit("windows"))


def usb_events(linux: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Both record shapes in one table."""
    events = conform(linux, USB_EVENT, kind=F.lit("linux"))
    return events if windows is None else events.unionByName(windows_usb_events(windows))
