"""Inputs: packets, target lists, labelled data sets, files, archives, reports, logs."""

import csv
import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from egresslens import constants as C
from egresslens.functions.binary import (
    content_md5, content_sha256, from_latin1, lossy_utf8, sha256, to_latin1,
)
from egresslens.functions.digests import ctph, locality
from egresslens.functions.filetype import detect_type, signature_type
from egresslens.functions.mime import peel
from egresslens.schemas import FILES, NETWORK_MATCH, RAW_PACKETS, REPORT, TARGETS, capture_of, conform
from egresslens.session import materialize

#: Where a log text is cut into lines.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def read_packets(spark: SparkSession, path: str, fmt: str = "json", schema: StructType = RAW_PACKETS,
                 capture_per_file: bool = True) -> DataFrame:
    """Packets of exported captures.

    A packet that names no capture belongs to the one its file is named for. Where one capture lies
    in several files, name it in the rows or set ``capture_per_file`` to False.
    """
    return normalize_packets(_named_captures(spark.read.schema(schema).format(fmt).load(path), capture_per_file))


def stream_packets(spark: SparkSession, path: str, fmt: str = "json", schema: StructType = RAW_PACKETS,
                   files_per_trigger: int | None = None, capture_per_file: bool = True) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return normalize_packets(_named_captures(reader.load(path), capture_per_file))


def _named_captures(packets: DataFrame, per_file: bool) -> DataFrame:
    file = F.col("_metadata.file_path") if per_file else F.lit(None).cast("string")
    return packets.withColumn("capture_id", F.coalesce(capture_of(packets), file))


def normalize_packets(raw: DataFrame) -> DataFrame:
    """Unreadable frame lengths become 0; addresses are read IPv4 before IPv6 downstream."""
    return raw.withColumn("length", F.coalesce(F.expr("try_cast(trim(CAST(length AS string)) AS bigint)"), F.lit(0)))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Target list with header; columns are found by name and missing ones are NULL."""
    return conform(spark.read.option("header", True).csv(path), TARGETS)


#: How CSV text of a number is written, whole or not; anything else makes a column text (or true and false).
WHOLE_NUMBER = r"^\s*[+-]?\d{1,18}\s*$"
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)\s*$"
TRUTH = r"(?i)^\s*(true|false)\s*$"
_FILE, _HEADER = "__file", "__header"


def labelled_text(spark: SparkSession, paths, label: str) -> DataFrame | None:
    """Rows of CSV files of one class, all columns text; None where no file has a line.

    Columns are found by name: the first line of each file is its header. Files are joined with their header
    in Spark; the driver sees each different header once.
    """
    skip = {"ignoreCorruptFiles": True, "ignoreMissingFiles": True}
    file = F.col("_metadata.file_path").alias(_FILE)
    line = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    headers = (spark.read.options(**skip).text(paths).select(file, "value", line.alias("at"))
               .groupBy(_FILE).agg(F.min_by("value", "at").alias(_HEADER)))
    headers = materialize(headers, "headers")
    layouts = sorted(row[0] for row in headers.select(_HEADER).distinct().collect())
    if not layouts:
        return None
    names = [next(csv.reader([layout])) if layout else [""] for layout in layouts]
    width = max(map(len, names))
    places = ", ".join(f"`{i}` string" for i in range(width))
    rows = (spark.read.options(header=True, enforceSchema=True, escape='"', **skip).schema(places).csv(paths)
            .select(*[f"`{i}`" for i in range(width)], file).join(headers, _FILE))
    columns = list(dict.fromkeys(n for layout in names for n in layout if n))

    def found(name: str) -> Column:
        value = F.lit(None).cast("string")
        for layout, held in zip(layouts, names):
            if name in held:
                value = F.when(F.col(_HEADER) == layout, F.col(f"`{held.index(name)}`")).otherwise(value)
        return F.nullif(value, F.lit(""))

    given = found("class") if "class" in columns else F.lit(None)
    return rows.select(*[found(n).alias(n) for n in columns if n != "class"],
                       F.coalesce(given, F.lit(label)).alias("class"))


def typed_columns(rows: DataFrame, keep=("class",)) -> DataFrame:
    """Text columns as the narrowest of whole numbers, numbers and truth values that all their values are; else text."""
    columns = [c for c in rows.columns if c not in keep]
    if not columns:
        return rows
    kinds = {"bigint": WHOLE_NUMBER, "double": NUMBER, "boolean": TRUTH}
    fits = rows.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(pattern)), F.lit(False)).alias(f"{i} {kind}")
                      for i, c in enumerate(columns) for kind, pattern in kinds.items()]).first()
    chosen = {c: next((k for k in kinds if fits[f"{i} {k}"]), "string") for i, c in enumerate(columns)}
    return rows.select(*[F.trim(f"`{c}`").cast(chosen[c]).alias(c) if chosen.get(c, "string") != "string" else F.col(f"`{c}`")
                         for c in rows.columns])


def load_labelled(spark: SparkSession, paths, label: str) -> DataFrame:
    """CSV files of one class; ``class`` is added, or its gaps are filled. Damaged files are skipped.

    Columns are found by name and united over all files; a column has one type, which all of its values fit.
    Files without a line are skipped.
    """
    rows = labelled_text(spark, paths, label)
    return spark.createDataFrame([], "class string") if rows is None else typed_columns(rows)


def load_category(spark: SparkSession, benign, malicious) -> DataFrame:
    """Both classes; a column has the same type in both."""
    parts = [labelled_text(spark, benign, "benign"), labelled_text(spark, malicious, "malicious")]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], "class string")
    return typed_columns(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below a directory: ``(path, size, content)``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", F.col("length").alias("size"), "content")


def _base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def target_rows(contents: DataFrame, fuzzy: bool = False, table=None) -> DataFrame:
    """Target list of ``(path, content)`` rows: digests of any content, and the type.

    Locality digests need the permutation ``table`` of the tool they are compared with.
    """
    data = F.col("content")
    size = F.octet_length(data).cast("bigint")
    ssdeep = ctph(data) if fuzzy else F.lit(None)
    tlsh = locality(data, table) if fuzzy and table is not None else F.lit(None)
    return conform(contents, TARGETS, sha256=sha256(data), md5=F.md5(data), ssdeep=ssdeep, tlsh=tlsh,
                   ftype=detect_type(_base_name(F.col("path")), size, data))


def targets_from_directory(spark: SparkSession, path: str, fuzzy: bool = False, table=None) -> DataFrame:
    return target_rows(read_files(spark, path), fuzzy, table)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for item in archive.infolist():
                    if not item.is_dir():
                        yield pd.DataFrame({"archive": [path], "path": [item.filename],
                                            "content": [archive.read(item)]})


def zip_members(archives: DataFrame) -> DataFrame:
    """One row per member of each archive ``(path, content)``; members stream one at a time."""
    return archives.select("path", "content").mapInPandas(
        _members, "archive string, path string, content binary")


def targets_from_zip(spark: SparkSession, path: str, fuzzy: bool = False, table=None) -> DataFrame:
    return target_rows(zip_members(read_files(spark, path)), fuzzy, table)


def inventory(contents: DataFrame, fuzzy: bool = False, table=None, ssdeep_from: int = 1,
              tlsh_from: int = 1) -> DataFrame:
    """Described files of ``(path, size, content[, deleted, partition_offset, ftype])``.

    Contents below ``ssdeep_from`` or ``tlsh_from`` bytes get no such digest; locality digests need
    the permutation ``table`` of the tool they are compared with.

    Deleted paths are tagged; empty content has no digests. Content is dropped here, before any
    shuffle. Both passes over allocated and deleted files are one scan.
    """
    has = lambda name: name in contents.columns
    removed = F.coalesce(F.col("deleted"), F.lit(False)) if has("deleted") else F.lit(False)
    path = F.concat(F.col("path"), F.when(removed, " (deleted)").otherwise(""))
    data = F.col("content")
    kind = F.col("ftype") if has("ftype") else detect_type(_base_name(F.col("path")), F.col("size"), data)
    return conform(
        contents.filter(F.col("size") > 0), FILES, path=path, deleted=removed, ftype=kind,
        sha256=content_sha256(data), md5=content_md5(data),
        ssdeep=ctph(data, ssdeep_from) if fuzzy else F.lit(None),
        tlsh=locality(data, table, tlsh_from) if fuzzy and table is not None else F.lit(None))


def describe_saved(contents: DataFrame) -> DataFrame:
    """Saved objects after peeling a multipart wrapper; peeled ones are marked in the name."""
    whole = F.col("content")
    inner = from_latin1(peel(to_latin1(whole)))
    name = _base_name(F.col("path"))
    peeled = contents.select(name.alias("name"), whole.alias("whole"), inner.alias("inner"))
    changed = F.col("inner") != F.col("whole")
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]+$", "")
    suffix = F.regexp_extract("name", r"(?<=.)(\.[^.]+)$", 1)
    return peeled.select(
        F.when(changed, F.concat(stem, F.lit("_cleaned"), suffix)).otherwise(F.col("name")).alias("filename"),
        F.octet_length("inner").cast("bigint").alias("size"), sha256(F.col("inner")).alias("sha256"),
        signature_type(F.col("inner")).alias("filetype")).orderBy("filename", "sha256")


def saved_objects(spark: SparkSession, path: str) -> DataFrame:
    return describe_saved(read_files(spark, path))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(REPORT).csv(path)


def parse_report_files(report: DataFrame) -> DataFrame:
    """Carried files of a long report: name, size, digest and type from the value text."""
    part = lambda pattern: F.nullif(F.regexp_extract("Value", pattern, 1), F.lit(""))
    rows = report.filter((F.col("Section") == "ParsedFile") & F.col("Value").isNotNull())
    return conform(
        rows, NETWORK_MATCH, name=F.trim("Key"), size=part(C.RE_REPORT_SIZE),
        sha256=part(C.RE_REPORT_SHA256), ftype=F.nullif(part(C.RE_REPORT_TYPE), F.lit("None")))


def log_lines(texts: DataFrame) -> DataFrame:
    """``(file, line_no, line)`` of whole log texts ``(file, text)``; line numbers count from 0."""
    return texts.select("file", F.posexplode(F.split("text", LINE_ENDS)).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of log files of any size, as ``log_lines`` of their whole texts.

    Bytes that are not UTF-8 are dropped, and so is a byte order mark. Spark cuts large files into splits; a split holds
    the records, ended by a line feed, that start in it. Lines are counted per split, the counts are added up in
    order of the splits' offsets, and the lines of all splits are numbered side by side.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset")]
    records = (spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
               .select(*split, F.monotonically_increasing_id().alias("at"), F.octet_length("value").alias("size"),
                       lossy_utf8(F.col("value").cast("binary")).alias("text")))
    ended = F.split(F.regexp_replace("text", "\r$", ""), LINE_ENDS)
    counts = materialize(records.groupBy("file", "offset").agg(
        F.sum(F.size(ended)).alias("lines"), F.sum(F.col("size") + 1).alias("bytes")), "log-splits")
    earlier = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "offset", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    sizes = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("length")))
    # Records and their line feeds make up the file, or one byte more when the last has none; a mark has three.
    files = materialize(sizes.join(counts.groupBy("file").agg(
        F.max("offset").alias("last"), F.sum("lines").alias("lines"), (F.sum("bytes")).alias("bytes")), "file", "left")
        .select("file", "last", "lines", (F.col("bytes") - F.col("length")).isin(1, -2).alias("cut")), "log-files")
    inside = Window.partitionBy("file", "offset").orderBy("at")
    placed = records.join(before, ["file", "offset"]).join(files.select("file", "last", "cut"), "file")
    final = (F.col("offset") == F.col("last")) & F.col("cut") & F.lead("at").over(inside).isNull()
    placed = placed.select("file", F.when(final, F.split("text", LINE_ENDS)).otherwise(ended).alias("pieces"), (
        F.col("before") + F.coalesce(F.sum(F.size(ended)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).alias("first"))
    lines = placed.select("file", "first", F.posexplode("pieces").alias("place", "line")).select(
        "file", (F.col("first") + F.col("place")).cast("bigint").alias("line_no"), "line")
    # What follows the last line feed is a line too. Spark's file readers pass empty files over.
    rest = files.filter(~F.coalesce("cut", F.lit(False))).select(
        "file", F.coalesce("lines", F.lit(0)).cast("bigint").alias("line_no"), F.lit("").alias("line"))
    return lines.unionByName(rest)


def preview(df: DataFrame, k: int = 5) -> DataFrame:
    return df.limit(k)
