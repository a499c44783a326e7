"""Outputs: long report, tables, text report, content export."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from egresslens import constants as C
from egresslens.schemas import REPORT, conform

RULE = "─" * 31


def _count_row(df: DataFrame, section: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("string").alias("Value")).select(
        F.lit(section).alias("Section"), F.lit("count").alias("Key"), "Value")


def _object_value(with_name: bool) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    saved = [F.lit("saved_as="), text("filename"), F.lit("; ")] if with_name else []
    return F.concat(*saved, text("size"), F.lit(" bytes; sha256="), text("sha256"), F.lit("; type="), text("filetype"))


def totals_rows(totals: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("Key"), F.col(c).cast("string").alias("Value")) for c in totals.columns])
    return totals.select(F.inline(pairs)).select(F.lit("Totals").alias("Section"), "Key", "Value")


def finding_rows(findings: DataFrame) -> DataFrame:
    fields = F.struct(*[c for c in findings.columns])
    return findings.select(F.lit("SuspReq").alias("Section"), F.col("frame_no").cast("string").alias("Key"),
                           F.to_json(fields).alias("Value"))


def object_rows(objects: DataFrame, section: str) -> DataFrame:
    with_name = section == "ParsedFile"
    key = F.coalesce(F.col("original_filename"), F.col("filename")) if with_name else F.col("filename")
    return objects.select(F.lit(section).alias("Section"), key.alias("Key"), _object_value(with_name).alias("Value"))


EXPORTS = {
    "http": ("Exported HTTP objects", "ExportedHTTPFile"),
    "ftp": ("Exported FTP/TFTP objects", "ExportedFTPFile"),
    "smb": ("Exported SMB objects", "ExportedSMBFile"),
}


def long_report(totals: DataFrame, outbound: DataFrame, findings: DataFrame, parsed: DataFrame,
                exported: dict[str, DataFrame] | None = None,
                destinations: int | None = C.REPORT_TOP_DESTINATIONS) -> DataFrame:
    """All results as ``(Section, Key, Value)`` rows of text; ``destinations`` None keeps all of them."""
    ranked = outbound.orderBy(F.desc("bytes"), "dst")
    top = (ranked if destinations is None else ranked.limit(destinations)).select(
        F.lit("TopDest").alias("Section"), F.col("dst").alias("Key"), F.col("bytes").cast("string").alias("Value"))
    parts = [totals_rows(totals), top, _count_row(findings, "SuspiciousRequests"), finding_rows(findings)]
    for channel, objects in (exported or {}).items():
        title, section = EXPORTS[channel]
        parts += [_count_row(objects, title), object_rows(objects, section)]
    parts += [_count_row(parsed, "ParsedSavedFiles"), object_rows(parsed, "ParsedFile")]
    return conform(reduce(DataFrame.unionByName, parts), REPORT)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns become JSON text."""
    flat = df.select(*[
        F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_features(features: DataFrame, path: str) -> bool:
    """Feature table; nothing is written when there are no rows."""
    if features.isEmpty():
        return False
    write_parquet(features, path)
    return True


def write_usb_history(events: DataFrame, registries: DataFrame, path: str) -> None:
    write_json(events, f"{path}/usb_history")
    write_json(registries, f"{path}/registries")


def export_content(matches: DataFrame, contents: DataFrame, path: str) -> None:
    """Content of the matched files as a table, paths without the leading slash."""
    rows = matches.select("path").join(contents.select("path", "content"), "path")
    write_parquet(rows.select(F.regexp_replace("path", "^/+", "").alias("path"), "content"), path)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label:<11}: "), F.coalesce(value.cast("string"), F.lit("N/A")))


def _optional(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), _line(label, value))


def file_blocks(matches: DataFrame, order: int, title: str) -> DataFrame:
    body = F.concat_ws("\n", _line("Path", F.col("path")), F.concat(_line("Size", F.col("size")), F.lit(" bytes")),
                       _line("Modified", F.lit(None).cast("string")), _line("Type", F.col("ftype")),
                       _line("SHA256", F.col("sha256")), _line("MD5", F.col("md5")),
                       _optional("SSDEEP", F.col("ssdeep")), _optional("TLSH", F.col("tlsh")),
                       _line("Match Type", F.col("match_type")), F.lit(RULE))
    return _section(matches.select(F.col("path").alias("key"), body.alias("text")), order, title,
                    f"No matching {title.lower()} found.")


def network_blocks(objects: DataFrame, order: int) -> DataFrame:
    body = F.concat_ws("\n", _line("Name", F.col("name")), _line("Size", F.col("size")),
                       _line("SHA256", F.col("sha256")), _line("File Type", F.col("ftype")), F.lit(RULE))
    return _section(objects.select(F.col("name").alias("key"), body.alias("text")), order,
                    "NETWORK EXFILTRATION MATCHES", "No suspicious network events found.")


def usb_blocks(events: DataFrame, order: int) -> DataFrame:
    """Windows records show device, instance and values; Linux ones their own fields."""
    pairs = F.transform(F.map_entries("values"), lambda e: F.concat(
        F.lit("  "), F.rpad(e["key"], 20, " "), F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    own = F.concat_ws("\n", *[_optional(n.capitalize(), F.col(n)) for n in
                              ("timestamp", "vendor", "product", "manufacturer", "description", "serial")])
    windows = F.concat_ws("\n", _line("Device", F.col("device_name")), _line("Instance", F.col("instance")),
                          F.array_join(pairs, "\n"))
    body = F.concat_ws("\n", F.when(F.col("kind") == "windows", windows).otherwise(own), F.lit(RULE))
    key = F.concat_ws("|", "kind", "device_name", "instance", "timestamp", "vendor", "product")
    return _section(events.select(key.alias("key"), body.alias("text")), order, "USB HISTORY",
                    "No USB activity detected.")


def _section(rows: DataFrame, order: int, title: str, none: str) -> DataFrame:
    head = F.concat_ws("\n", F.lit(title), F.lit(RULE))
    size = F.col("n")
    first = rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(order).alias("part"), F.lit("").alias("key"),
        F.when(size > 0, head).otherwise(F.concat_ws("\n", head, F.lit(none))).alias("text"), F.lit(0).alias("step"))
    return first.unionByName(rows.select(F.lit(order).alias("part"), "key", "text", F.lit(1).alias("step")))


def text_report(matches: DataFrame, network: DataFrame, usb: DataFrame, summary: DataFrame) -> DataFrame:
    """Blocks of the human readable report in order: ``(part, step, key, text)``."""
    lines = [("Matching allocated files ", "allocated"), ("Matching deleted files   ", "deleted"),
             ("Suspicious network events", "network"), ("USB history entries      ", "usb")]
    head = summary.select(
        F.lit(0).alias("part"), F.lit("").alias("key"),
        F.concat_ws("\n", F.lit("FORENSIC ANALYSIS REPORT"), F.lit("SUMMARY"), F.lit(RULE),
                    *[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in lines],
                    F.lit(RULE)).alias("text"), F.lit(0).alias("step"))
    parts = [head, file_blocks(matches.filter(~F.col("deleted")), 1, "ALLOCATED FILE MATCHES"),
             file_blocks(matches.filter("deleted"), 2, "DELETED FILE MATCHES"),
             network_blocks(network, 3), usb_blocks(usb, 4)]
    return reduce(DataFrame.unionByName, parts)


def write_text_report(blocks: DataFrame, path: str) -> None:
    blocks.orderBy("part", "step", "key").select("text").write.mode("overwrite").text(path)
