"""Registered queries over file inventories, target lists, sources and sinks."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from egresslens import constants as C

from egresslens.functions.digests import ctph, locality, pearson_table
from egresslens.operators import duplicates, filters, fuzzy, match, usb
from egresslens.plans import disk
from egresslens.plans.bridges import bridge, contents, packets, table
from egresslens.plans.registry import query
from egresslens.schemas import FILES, conform, require_columns
from egresslens.session import materialize, work_path
from egresslens.sources import readers, sinks
from egresslens.sources.files import read_content_files, write_content_files

_COLUMNS = ["path", "size", "sha256", "md5", "deleted", "partition_offset", "ftype"]
_F = ", ".join(f"f.{c}" for c in _COLUMNS)


def _files(spark, sf):
    return bridge(spark, sf, "b_files").select(*_COLUMNS)


def _targets(spark, sf):
    return bridge(spark, sf, "b_targets").drop("doc_id")


# --- filters -----------------------------------------------------------------------------------

@query("f07_deleted_files", f"SELECT {_F} FROM b_files f WHERE deleted")
def _(spark, sf):
    return filters.deleted(_files(spark, sf))


@query("f07_allocated_files", f"SELECT {_F} FROM b_files f WHERE NOT deleted")
def _(spark, sf):
    return filters.allocated(_files(spark, sf))


@query("f08_non_empty_files", "SELECT path, size FROM b_files WHERE size > 0")
def _(spark, sf):
    return filters.non_empty_files(_files(spark, sf)).select("path", "size")


_PREFIX = "SELECT path, ftype FROM b_files WHERE starts_with(ftype, 'text/e') OR starts_with(ftype, 'text/fr')"


@query("f09_type_prefix", _PREFIX)
def _(spark, sf):
    allowed = spark.createDataFrame([("text/e",), ("text/fr",), (None,)], "ftype string")
    return filters.type_prefix_filter(_files(spark, sf), allowed).select("path", "ftype")


@query("j10_prefix_join", """
    SELECT path, ftype FROM b_files f WHERE EXISTS (SELECT 1 FROM b_targets t WHERE starts_with(f.ftype, substr(t.ftype, 1, 6)))""")
def _(spark, sf):
    wanted = bridge(spark, sf, "b_targets").select(F.substring("ftype", 1, 6).alias("ftype"))
    return filters.type_prefix_filter(_files(spark, sf), wanted).select("path", "ftype")


@query("f11_path_suffix", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hive' WHEN 1 THEN 'hive' WHEN 2 THEN 'log' END AS kind FROM documents""")
def _(spark, sf):
    kind = F.col("doc_id") % 4
    path = F.concat(F.lit("/Mnt"), F.when(kind == 0, "/WINDOWS/system32/config/SYSTEM")
                    .when(kind == 1, "/Windows/System32/config/SYSTEM (deleted)").when(kind == 2, "/var/log/Kern.log")
                    .otherwise("/var/log/kern.log.1"))
    named = table(spark, sf, "documents").select("doc_id", path.alias("path"))
    hive, log = filters.path_ends_with(C.WINDOWS_HIVE_SUFFIXES), filters.path_ends_with(C.LINUX_LOG_SUFFIXES)
    return named.select("doc_id", F.when(hive, "hive").when(log, "log").alias("kind"))


def _report(spark, sf):
    docs = bridge(spark, sf, "b_files")
    value = F.concat(F.lit("saved_as=x; "), F.col("size").cast("string"), F.lit(" bytes; sha256="), F.col("sha256"),
                     F.lit("; type="), F.when(F.col("doc_id") % 2 == 0, F.col("ftype")).otherwise("None"), F.lit("; pkt=None"))
    section = F.when(F.col("doc_id") % 3 == 0, "Totals").otherwise("ParsedFile")
    return docs.select(section.alias("Section"), F.concat(F.lit(" "), F.col("path")).alias("Key"), value.alias("Value"))


@query("f13_report_rows", "SELECT ' ' || path AS \"Key\" FROM b_files WHERE doc_id % 3 <> 0")
def _(spark, sf):
    return filters.report_rows(_report(spark, sf)).select("Key")


@query("f14_null_filter", "SELECT path, sha256 FROM b_targets WHERE sha256 IS NOT NULL")
def _(spark, sf):
    return filters.with_value(_targets(spark, sf), "sha256").select("path", "sha256")


@query("f15_without_usb_files", """
    SELECT path FROM (SELECT file AS path FROM b_usb UNION SELECT path FROM b_files) WHERE path IS NOT NULL
    AND path NOT IN (SELECT file FROM b_usb WHERE line LIKE '%idVendor=%' AND line LIKE '%usb 1-1%' AND file IS NOT NULL)""")
def _(spark, sf):
    lines = bridge(spark, sf, "b_usb")
    paths = lines.select(F.col("file").alias("path")).union(_files(spark, sf).select("path")).distinct().dropna()
    return filters.without_usb_files(paths, usb.linux_usb_events(lines))


@query("f16_known_columns", "SELECT path, md5 FROM b_targets")
def _(spark, sf):
    return filters.keep_known(_targets(spark, sf), ["path", "md5", "ssdeep"])


@query("f17_required_columns", "SELECT CAST(count(*) AS BIGINT) AS files, TRUE AS refused FROM b_files")
def _(spark, sf):
    files = _files(spark, sf)
    require_columns(files, match.REQUIRED)
    try:
        require_columns(files.drop("md5"), match.REQUIRED)
        refused = False
    except KeyError:
        refused = True
    return files.agg(F.count(F.lit(1)).alias("files"), F.lit(refused).alias("refused"))


@query("f18_projection", "SELECT frame_no, p1 FROM b_scores")
def _(spark, sf):
    return bridge(spark, sf, "b_scores").drop("y", "p2", "lang", "source", "chars")


# --- matching ----------------------------------------------------------------------------------

@query("j01_sha256_match", f"SELECT {_F} FROM b_files f SEMI JOIN b_targets t ON f.sha256 = t.sha256")
def _(spark, sf):
    return match.hash_match(_files(spark, sf), _targets(spark, sf), "sha256")


@query("j02_md5_match", f"SELECT {_F} FROM b_files f SEMI JOIN b_targets t ON f.md5 = t.md5")
def _(spark, sf):
    return match.hash_match(_files(spark, sf), _targets(spark, sf), "md5")


_BAG = f"""SELECT {_F}, 'sha256' AS match_type FROM b_files f SEMI JOIN b_targets t ON f.sha256 = t.sha256
    UNION ALL SELECT {_F}, 'md5' FROM b_files f SEMI JOIN b_targets t ON f.md5 = t.md5"""


@query("u01_match_bag", _BAG)
def _(spark, sf):
    return match.exact_matches(_files(spark, sf), _targets(spark, sf))


_FIRST = f"""WITH bag AS ({_BAG}), ranked AS (SELECT *, row_number() OVER (PARTITION BY path
    ORDER BY CASE match_type WHEN 'sha256' THEN 1 ELSE 2 END, partition_offset) AS rn FROM bag)
    SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1"""


@query("w01_first_per_path", _FIRST)
def _(spark, sf):
    return match.first_per_path(match.exact_matches(_files(spark, sf), _targets(spark, sf)))


@query("w01_single_pass_match", _FIRST)
def single_pass(spark, sf):
    return disk.match_files(_files(spark, sf), _targets(spark, sf), use_fuzzy=False).drop("score")


@query("u03_target_hashes", """
    SELECT sha256 AS hash FROM b_targets WHERE sha256 IS NOT NULL UNION SELECT md5 FROM b_targets""")
def _(spark, sf):
    return match.target_hash_set(_targets(spark, sf))


@query("j05_network_matches", "SELECT path AS name, size, sha256, CAST(NULL AS STRING) AS md5, ftype FROM b_files f SEMI JOIN b_targets t ON f.sha256 = t.sha256")
def _(spark, sf):
    carried = bridge(spark, sf, "b_files").select(F.col("path").alias("name"), "size", "sha256",
                                                   F.lit(None).cast("string").alias("md5"), "ftype")
    return match.network_matches(carried, _targets(spark, sf))


@query("a08_match_counts", """
    SELECT CAST((SELECT count(*) FROM b_files f SEMI JOIN b_targets t ON f.md5 = t.md5) AS BIGINT) AS exact_matches, CAST(0 AS BIGINT) AS fuzzy_matches""")
def _(spark, sf):
    return match.match_counts(disk.match_files(_files(spark, sf), _targets(spark, sf), use_fuzzy=False))


@query("a09_report_summary", """
    WITH m AS (SELECT * FROM b_files f SEMI JOIN b_targets t ON f.md5 = t.md5)
    SELECT CAST(count(*) FILTER (WHERE NOT deleted) AS BIGINT) AS allocated, CAST(count(*) FILTER (WHERE deleted) AS BIGINT) AS deleted,
      CAST((SELECT count(*) FROM b_files f SEMI JOIN b_targets t ON f.sha256 = t.sha256) AS BIGINT) AS network,
      CAST((SELECT count(*) FROM b_usb WHERE line LIKE '%usb 1-1: idVendor%') AS BIGINT) AS usb FROM m""")
def _(spark, sf):
    files, targets = _files(spark, sf), _targets(spark, sf)
    return match.report_summary(match.first_per_path(match.exact_matches(files, targets)),
                                match.network_matches(files, targets), usb.linux_usb_events(bridge(spark, sf, "b_usb")))


@query("a13_distinct_types", "SELECT DISTINCT ftype FROM b_targets")
def _(spark, sf):
    from egresslens.operators.stats import distinct_values
    return distinct_values(_targets(spark, sf), "ftype")


@query("u07_combined_targets", """
    SELECT path, sha256, md5, ftype FROM b_targets UNION ALL
    SELECT path, sha256, md5, ftype FROM b_files""")
def _(spark, sf):
    first = _targets(spark, sf).select("path", "sha256", "md5", "ftype")
    second = bridge(spark, sf, "b_files").select("path", "sha256", "md5", "ftype")
    return match.combined_targets(first, second.unionByName(first.withColumn("md5", F.lit("late"))))


# Similarity digests whose bodies agree within a block of ten documents, made of the tables' texts.
_TLSH_HEAD = "'A' || substr(md5(text), 1, 1) || substr('0123', CAST(doc_id % 4 AS INT) + 1, 1) || '7' || '5' || substr('456', CAST(doc_id % 3 AS INT) + 1, 1)"
_TLSH = f"upper({_TLSH_HEAD} || substr({{body}}, 1, 56) || substr({{sha}}, 1, 8))"


def _tlsh_sql(engine):
    sha = "sha2({}, 256)" if engine == "spark" else "sha256({})"
    group = "CAST(CAST(floor(doc_id / 10) AS BIGINT) AS STRING)"
    return _TLSH.replace("{body}", sha.format(group)).replace("{sha}", sha.format("text"))


_D = lambda part: f"""list_sum(list_transform(range(0, 128), lambda i: CASE abs({part('a', 'i')} - {part('b', 'i')}) WHEN 3 THEN 6 ELSE abs({part('a', 'i')} - {part('b', 'i')}) END))"""
_CODE = lambda side, i: f"((strpos('0123456789ABCDEF', substr({side}.d, CAST(7 + {i} // 2 AS INT), 1)) - 1) // (CASE WHEN {i} % 2 = 0 THEN 4 ELSE 1 END) % 4)"
_NIB = lambda side, k: f"(strpos('0123456789ABCDEF', substr({side}.d, {k}, 1)) - 1)"
_GAP = lambda a, b, n: f"least(abs({a} - {b}), {n} - abs({a} - {b}))"
_QUART = lambda k: f"(CASE WHEN {_GAP(_NIB('a', k), _NIB('b', k), 16)} <= 1 THEN {_GAP(_NIB('a', k), _NIB('b', k), 16)} ELSE ({_GAP(_NIB('a', k), _NIB('b', k), 16)} - 1) * 12 END)"
_LEN = lambda side: f"({_NIB(side, 4)} * 16 + {_NIB(side, 3)})"
_LENGTH = f"(CASE WHEN {_GAP(_LEN('a'), _LEN('b'), 256)} <= 1 THEN {_GAP(_LEN('a'), _LEN('b'), 256)} ELSE {_GAP(_LEN('a'), _LEN('b'), 256)} * 12 END)"
_TLSH_ORACLE = f"""
    WITH a AS (SELECT doc_id, {_tlsh_sql('duckdb')} AS d FROM documents WHERE doc_id % 5 <> 0),
    b AS (SELECT doc_id, {_tlsh_sql('duckdb')} AS d FROM documents WHERE doc_id % 5 = 0),
    p AS (SELECT a.doc_id, a.d AS file_digest, b.d AS target_digest, CAST({_LENGTH} + {_QUART(5)} + {_QUART(6)}
          + CAST(substr(a.d, 1, 2) <> substr(b.d, 1, 2) AS INT) + {_D(_CODE)} AS BIGINT) AS distance FROM a, b)
"""


def _with_tlsh(spark, sf, condition, path):
    docs = table(spark, sf, "documents")
    return docs.filter(condition).select("doc_id", F.concat(F.lit(path), F.col("doc_id").cast("string")).alias("path"),
                                         F.expr(_tlsh_sql("spark")).alias("tlsh"))


@query("j04_tlsh_distances", _TLSH_ORACLE + "SELECT DISTINCT file_digest, target_digest, distance FROM p WHERE distance <= 50")
def tlsh_distances(spark, sf):
    return fuzzy.tlsh_distances(_with_tlsh(spark, sf, "doc_id % 5 <> 0", "/"), _with_tlsh(spark, sf, "doc_id % 5 = 0", "/t/"))


@query("j04_tlsh_match", _TLSH_ORACLE + "SELECT doc_id, 'tlsh (diff=' || CAST(min(distance) AS STRING) || ')' AS match_type FROM p WHERE distance <= 50 GROUP BY doc_id")
def _(spark, sf):
    files = _with_tlsh(spark, sf, "doc_id % 5 <> 0", "/")
    return fuzzy.tlsh_matches(files, _with_tlsh(spark, sf, "doc_id % 5 = 0", "/t/")).select("doc_id", "match_type")


# Piecewise signatures: 60 characters shared by ten documents with four of their own in the middle.
def _ssdeep_sql(engine):
    sha = "sha2({}, 256)" if engine == "spark" else "sha256({})"
    group = sha.format("CAST(CAST(floor(doc_id / 10) AS BIGINT) AS STRING)")
    own = sha.format("text")
    return f"'1536:' || substr({group}, 1, 30) || substr({own}, 1, 4) || substr({group}, 31, 30) || ':' || substr({own}, 5, 25)"


_CUT = "regexp_replace(" * 16
_RUNS = lambda x: _CUT + x + "".join(f", '{c}{{4,}}', '{c * 3}', 'g')" for c in "0123456789abcdef")
_LCS = """len(list_filter(range(0, 64), lambda k: (list_reduce(list_prepend(CAST(18446744073709551615 AS UHUGEINT),
    list_transform(string_split(y, ''), lambda c: list_reduce(list_prepend(0::UHUGEINT, list_transform(list_filter(range(0, length(x)),
      lambda i: substr(x, CAST(i + 1 AS INT), 1) = c), lambda i: CAST(pow(2, i) AS UHUGEINT))), lambda p, q: p | q))),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & CAST(18446744073709551615 AS UHUGEINT)) >> k::UHUGEINT) & 1::UHUGEINT = 0))"""


@query("j03_ssdeep_scores", f"""
    WITH s AS (SELECT doc_id, {_ssdeep_sql('duckdb')} AS d FROM documents),
    c AS (SELECT doc_id, d, {_RUNS("string_split(d, ':')[2]")} AS x FROM s),
    pre AS (SELECT a.d AS file_digest, b.d AS target_digest, a.x AS x, b.x AS y FROM c a JOIN c b
      ON CAST(floor(a.doc_id / 10) AS BIGINT) = CAST(floor(b.doc_id / 10) AS BIGINT) AND a.doc_id % 5 <> 0 AND b.doc_id % 5 = 0),
    l AS (SELECT DISTINCT file_digest, target_digest, length(x) + length(y) AS n, {_LCS} AS common FROM pre)
    SELECT file_digest, target_digest, max(score) AS score FROM (
      SELECT file_digest, target_digest, CAST(100 - 100 * ((n - 2 * common) * 64 // n) // 64 AS BIGINT) AS score FROM l
      UNION ALL SELECT a.d, b.d, 100 FROM s a JOIN s b ON string_split(a.d, ':')[3] = string_split(b.d, ':')[3]
        AND a.doc_id % 5 <> 0 AND b.doc_id % 5 = 0) u
    WHERE score >= 90 GROUP BY file_digest, target_digest""")
def ssdeep_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(_ssdeep_sql("spark")).alias("ssdeep"))
    return fuzzy.ssdeep_scores(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0"))


def _content(spark, sf, condition):
    return contents(spark, sf).filter(condition)


@query("x32_ssdeep_digest")
def _(spark, sf):
    return contents(spark, sf).select("doc_id", ctph(F.col("content")).alias("ssdeep"))


@query("x33_tlsh_digest")
def _(spark, sf):
    return contents(spark, sf).select("doc_id", locality(F.col("content"), pearson_table()).alias("tlsh"))


@query("j03_ssdeep_content_match")
def ssdeep_content(spark, sf):
    digest = lambda df: materialize(df.select(
        "doc_id", "path", ctph(F.col("content")).alias("ssdeep")), "digests")
    return fuzzy.ssdeep_matches(digest(_content(spark, sf, "doc_id % 5 <> 0")), digest(_content(spark, sf, "doc_id % 5 = 0")))


@query("j04_tlsh_content_match")
def tlsh_content(spark, sf):
    digest = lambda df: materialize(df.select(
        "doc_id", "path", locality(F.col("content"), pearson_table()).alias("tlsh")), "digests")
    return fuzzy.tlsh_matches(digest(_content(spark, sf, "doc_id % 5 <> 0")), digest(_content(spark, sf, "doc_id % 5 = 0")))


@query("disk_triage")
def disk_triage(spark, sf):
    """Whole disk analysis with exact and similarity matching on content."""
    files = readers.inventory(_content(spark, sf, "doc_id % 5 <> 0"), fuzzy=True, table=pearson_table())
    targets = readers.target_rows(_content(spark, sf, "doc_id % 5 = 0").select("path", "content"), fuzzy=True,
                                  table=pearson_table())
    devices = usb.usb_events(usb.linux_usb_events(bridge(spark, sf, "b_usb")))
    carried = conform(files, FILES).withColumnRenamed("path", "name")
    return disk.run(files, targets, carried, devices).matches


@query("disk_triage_exact", """
    WITH logs AS (SELECT '/' || source || '/' || CAST(doc_id AS VARCHAR) AS file FROM documents WHERE doc_id % 5 = 1 AND doc_id % 3 = 0),
    f AS (SELECT * FROM b_files WHERE size > 0 AND path NOT IN (SELECT file FROM logs)
          AND EXISTS (SELECT 1 FROM b_targets t WHERE starts_with(b_files.ftype, t.ftype)))
    SELECT path, CASE WHEN sha256 IN (SELECT sha256 FROM b_targets WHERE sha256 IS NOT NULL) THEN 'sha256' ELSE 'md5' END AS match_type,
           CAST((SELECT count(*) FROM logs) AS BIGINT) AS devices
    FROM f WHERE sha256 IN (SELECT sha256 FROM b_targets WHERE sha256 IS NOT NULL) OR md5 IN (SELECT md5 FROM b_targets)""")
def disk_triage_exact(spark, sf):
    """Whole disk analysis on ready-made digests; some files of the inventory are logs that name a device."""
    logs = table(spark, sf, "documents").filter("doc_id % 5 = 1").select(
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file"),
        F.lit(0).cast("bigint").alias("line_no"),
        F.when(F.col("doc_id") % 3 == 0, "Jan  3 10:11:12 h kernel: usb 1-1: idVendor=07, idProduct=08").otherwise(
            "Jan  3 10:11:12 h sshd: none").alias("line"))
    files = _files(spark, sf)
    triage = disk.run_with_logs(files, _targets(spark, sf), files.withColumnRenamed("path", "name"), logs, use_fuzzy=False)
    devices = triage.usb.agg(F.count(F.lit(1)).alias("n")).scalar()
    return triage.matches.select("path", "match_type").withColumn("devices", devices)


# --- sources -----------------------------------------------------------------------------------

_DAMAGED = "CASE WHEN sub_no = 3 THEN 0 ELSE length END"


def _raw_packets(spark, sf):
    length = F.when(F.col("sub_no") == 3, "?").otherwise(F.col("length").cast("string"))
    nested = bridge(spark, sf, "b_packets").withColumn("length", length)
    return nested.select("frame_no", F.col("ts").cast("timestamp").alias("ts"), "length",
                         F.struct("src", "dst").alias("ip"))


@query("s01_packet_scan", f"""
    SELECT src, CAST(count(*) AS BIGINT) AS frames, CAST(sum({_DAMAGED}) AS BIGINT) AS bytes FROM b_packets GROUP BY src""")
def _(spark, sf):
    path = work_path(spark, "packets-json")
    _raw_packets(spark, sf).write.json(path)
    return readers.read_packets(spark, path).groupBy(F.col("ip.src").alias("src")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("length").alias("bytes"))


@query("s02_length_and_address", f"SELECT frame_no, {_DAMAGED} AS length, src, dst FROM b_packets")
def _(spark, sf):
    raw = _raw_packets(spark, sf).select(
        "frame_no", "length", F.when(F.col("frame_no") % 2 == 0, F.col("ip")).alias("ip"), F.col("ip").alias("ipv6"))
    return readers.normalize_packets(raw).select(
        "frame_no", "length", filters.source().alias("src"), filters.destination().alias("dst"))


@query("s03_target_list", "SELECT path, sha256, md5, CAST(NULL AS STRING) AS ssdeep, CAST(NULL AS STRING) AS tlsh, ftype FROM b_targets")
def _(spark, sf):
    path = work_path(spark, "targets-csv")
    sinks.write_csv(_targets(spark, sf), path)
    return readers.read_targets(spark, path)


def _class_files(spark, sf):
    path = work_path(spark, "classes")
    scores = bridge(spark, sf, "b_scores")
    sinks.write_csv(scores.filter("y = 0").select("frame_no", "chars"), f"{path}/benign")
    mixed = F.when(F.col("frame_no") % 2 == 0, "malicious")
    sinks.write_csv(scores.filter("y = 1").select("frame_no", "p1", mixed.alias("class")), f"{path}/malicious")
    return path


@query("s04_labelled_files", "SELECT frame_no, p1, 'malicious' AS class FROM b_scores WHERE y = 1")
def _(spark, sf):
    loaded = readers.load_labelled(spark, _class_files(spark, sf) + "/malicious/*.csv", "malicious")
    return loaded.select(F.col("frame_no").cast("bigint").alias("frame_no"), "p1", "class")


_TWO_TYPES = "SELECT CASE WHEN y = 1 THEN CAST(frame_no AS STRING) ELSE 'x' || CAST(frame_no AS STRING) END AS key, frame_no % 7 AS n, CASE y WHEN 1 THEN 'malicious' ELSE 'benign' END AS class FROM b_scores"


def _files_of_two_types(spark, sf):
    """A column that is a number in one set of files and text in the other, at different places."""
    path = work_path(spark, "two-types")
    scores = bridge(spark, sf, "b_scores").withColumn("n", F.col("frame_no") % 7)
    sinks.write_csv(scores.filter("y = 1").select(F.col("frame_no").alias("key"), "n"), f"{path}/malicious")
    sinks.write_csv(scores.filter("y <> 1").select("n", F.concat(F.lit("x"), F.col("frame_no").cast("string")).alias("key")),
                    f"{path}/benign")
    return path


@query("s04_columns_of_two_types", _TWO_TYPES.replace("CASE y WHEN 1 THEN 'malicious' ELSE 'benign' END", "'any'"))
def _(spark, sf):
    return readers.load_labelled(spark, _files_of_two_types(spark, sf) + "/*/*.csv", "any").select("key", "n", "class")


@query("s05_columns_of_two_types", _TWO_TYPES)
def _(spark, sf):
    path = _files_of_two_types(spark, sf)
    return readers.load_category(spark, path + "/benign/*.csv", path + "/malicious/*.csv").select("key", "n", "class")


@query("s05_category_load", "SELECT CASE y WHEN 1 THEN 'malicious' ELSE 'benign' END AS class, CAST(count(*) AS BIGINT) AS n FROM b_scores GROUP BY 1")
def _(spark, sf):
    from egresslens.operators.stats import class_distribution
    path = _class_files(spark, sf)
    return class_distribution(readers.load_category(spark, path + "/benign/*.csv", path + "/malicious/*.csv"))


@query("u05_category_union", "SELECT frame_no, CASE y WHEN 1 THEN NULL ELSE chars END AS chars, CASE y WHEN 1 THEN p1 END AS p1 FROM b_scores")
def _(spark, sf):
    path = _class_files(spark, sf)
    both = readers.load_category(spark, path + "/benign/*.csv", path + "/malicious/*.csv")
    return both.select(F.col("frame_no").cast("bigint").alias("frame_no"), "chars", "p1")


def _folder_name(value):
    """A value as a step of a path, spelled as Spark names the folders of a partition."""
    named = F.coalesce(F.nullif(value, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    for char in "%\"#'*/:=?\\{[]^\x7f":
        named = F.replace(named, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return named


@query("s06_directory_targets", """
    SELECT source, CAST(count(*) AS BIGINT) AS files, max(sha256(text || chr(10))) AS sha256, min(md5(text || chr(10))) AS md5 FROM documents GROUP BY source""")
def _(spark, sf):
    path = work_path(spark, "tree")
    docs = table(spark, sf, "documents").groupBy("source", F.col("doc_id").alias("id")).agg(
        F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n").alias("lines"))
    name = F.concat(F.lit("source="), _folder_name(F.col("source")), F.lit("/id="), _folder_name(F.col("id").cast("string")), F.lit(".txt"))
    # A folder for every document would be moved by the driver one by one.
    write_content_files(docs.select(name.alias("path"), F.encode(F.concat("lines", F.lit("\n")), "UTF-8").alias("content")), path)
    listed = readers.targets_from_directory(spark, path)
    return listed.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("files"), F.max("sha256").alias("sha256"), F.min("md5").alias("md5"))


def _zipped(pdf: pd.DataFrame) -> pd.DataFrame:
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for name, text in zip(pdf["doc_id"], pdf["text"]):
            archive.writestr(f"docs/{name}.txt", text)
    return pd.DataFrame({"path": [f"{pdf['batch'].iloc[0]}.zip"], "content": [packed.getvalue()]})


@query("s07_zip_targets", "SELECT 'docs/' || CAST(doc_id AS STRING) || '.txt' AS path, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(spark, sf):
    # Archives of twenty documents each.
    docs = table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 20).alias("batch"))
    archives = docs.groupBy("batch").applyInPandas(_zipped, "path string, content binary")
    return readers.target_rows(readers.zip_members(archives)).select("path", "sha256", "md5")


@query("s08_inventory", f"""
    SELECT '/' || source || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 7 = 0 THEN ' (deleted)' ELSE '' END AS path,
      CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, md5(text) AS md5, doc_id % 7 = 0 AS deleted FROM documents""")
def _(spark, sf):
    return readers.inventory(contents(spark, sf)).select("path", "size", "sha256", "md5", "deleted")


_PARSED = "SELECT path AS name, size, sha256, CAST(NULL AS STRING) AS md5, CASE WHEN doc_id % 2 = 0 THEN 'text' END AS ftype FROM b_files WHERE doc_id % 3 <> 0"


@query("s09_report_scan", _PARSED)
def _(spark, sf):
    path = work_path(spark, "report-csv")
    sinks.write_csv(_report(spark, sf), path)
    return readers.parse_report_files(readers.read_report(spark, path))


@query("x19_report_value", _PARSED)
def _(spark, sf):
    return readers.parse_report_files(_report(spark, sf))


@query("s10_log_lines", """
    SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(max(length(x)) AS BIGINT) AS longest
    FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x FROM documents) d GROUP BY doc_id, text""")
def _(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
    return readers.log_lines(texts).groupBy(F.col("file").alias("doc_id")).agg(
        (F.max("line_no") + 1).alias("lines"), F.max(F.length("line")).cast("bigint").alias("longest"))


@query("s10_log_files", r"""
    WITH lines AS (
      SELECT source, unnest(string_split_regex(coalesce(text, '') || chr(10), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')[:-2]) AS line
      FROM documents)
    SELECT source, CAST(count(*) AS BIGINT) + 1 AS lines, CAST(count(*) AS BIGINT) + 1 AS numbers, CAST(count(*) AS BIGINT) AS last,
           CAST(sum(length(line)) AS BIGINT) AS chars, CAST(max(length(line)) AS BIGINT) AS longest FROM lines GROUP BY source""")
def _(spark, sf):
    """Whole documents as log files, one a source, read in splits; every line has a number of its own."""
    path = work_path(spark, "logs")
    docs = table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("source").write.option("lineSep", "\n").partitionBy("source").text(path)
    lines = readers.read_log_lines(spark, path)
    return lines.groupBy(F.regexp_extract("file", "source=([^/]+)", 1).alias("source")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("line_no").alias("numbers"), F.max("line_no").alias("last"),
        F.sum(F.length("line")).cast("bigint").alias("chars"), F.max(F.length("line")).cast("bigint").alias("longest"))


@query("u04_near_duplicates", r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    t AS MATERIALIZED (SELECT array_to_string(w, ' ') AS node, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY 1),
    s AS MATERIALIZED (SELECT DISTINCT node, array_to_string(w[i:i + 4], ' ') AS s
          FROM t, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i)),
    n AS (SELECT node, count(*) AS n FROM s GROUP BY 1),
    common AS (SELECT x.node AS a, y.node AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.node <> y.node GROUP BY ALL),
    pairs AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.node = a JOIN n q ON q.node = b WHERE 10 * c >= 8 * (p.n + q.n - c)),
    walk AS (SELECT node AS a, node AS b FROM t UNION SELECT walk.a, pairs.b FROM walk JOIN pairs ON pairs.a = walk.b),
    root AS (SELECT a AS node, min(b) AS root FROM walk GROUP BY a),
    classed AS (SELECT doc_id, coalesce(root, 'alone' || CAST(row_number() OVER () AS STRING)) AS class FROM w LEFT JOIN root ON array_to_string(w, ' ') = node)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id, count(*) OVER (PARTITION BY class) AS class_size FROM classed""")
def near_duplicates(spark, sf):
    """Classes of documents whose runs of five words are similar by 0.8 or more."""
    return duplicates.near_duplicates(table(spark, sf, "documents"), "doc_id").select("doc_id", "class_id", "class_size")


@query("s11_saved_objects", r"""
    SELECT CAST(frame_no AS STRING) || '_cleaned.bin' AS filename, CAST(strlen(regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g')) AS BIGINT) AS size,
      sha256(regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g')) AS sha256 FROM b_mime""")
def _(spark, sf):
    saved = bridge(spark, sf, "b_mime").select(
        F.concat(F.lit("/out/"), F.col("frame_no").cast("string"), F.lit(".bin")).alias("path"), F.encode("body", "UTF-8").alias("content"))
    return readers.describe_saved(saved).select("filename", "size", "sha256")


@query("t04_files_by_name", "SELECT path FROM b_files ORDER BY path")
def _(spark, sf):
    return _files(spark, sf).select("path").orderBy("path")


@query("t05_preview", "SELECT CAST(5 AS BIGINT) AS n")
def _(spark, sf):
    return readers.preview(_files(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


# --- sinks -------------------------------------------------------------------------------------

def _read_back(spark, sf, write, df, fmt):
    path = work_path(spark, "sink")
    write(df, path)
    return spark.read.schema(df.schema).option("header", True).option("escape", '"').format(fmt).load(path)


@query("k02_inventory_csv", f"SELECT {_F} FROM b_files f")
def _(spark, sf):
    return _read_back(spark, sf, sinks.write_csv, _files(spark, sf), "csv")


@query("k03_usb_json", "SELECT file, line_no FROM b_usb WHERE line LIKE '%usb 1-1: idVendor%'")
def _(spark, sf):
    path = work_path(spark, "usb-json")
    events = usb.linux_usb_events(bridge(spark, sf, "b_usb")).select("file", "line_no", "vendor")
    registries = events.select(F.col("file").alias("path")).distinct()
    sinks.write_usb_history(events, registries, path)
    return spark.read.schema(events.schema).json(f"{path}/usb_history").select("file", "line_no")


@query("k04_matches_csv", _FIRST)
def _(spark, sf):
    found = match.first_per_path(match.exact_matches(_files(spark, sf), _targets(spark, sf)))
    return _read_back(spark, sf, sinks.write_csv, found, "csv")


@query("k05_feature_table", "SELECT frame_no, CAST(length(rtrim(qname, '.')) AS BIGINT) AS len, TRUE AS empty_skipped FROM b_dns")
def _(spark, sf):
    from egresslens.operators.dns import lexical_features
    features = lexical_features(packets(spark, sf, "b_dns"))
    path = work_path(spark, "features")
    sinks.write_features(features, path)
    skipped = not sinks.write_features(features.limit(0), path)
    return spark.read.schema(features.schema).parquet(path).select("frame_no", "len", F.lit(skipped).alias("empty_skipped"))


@query("k06_combined_dataset", "SELECT frame_no, CASE y WHEN 1 THEN 'malicious' ELSE 'benign' END AS class FROM b_scores")
def _(spark, sf):
    path = _class_files(spark, sf)
    both = readers.load_category(spark, path + "/benign/*.csv", path + "/malicious/*.csv").select(
        F.col("frame_no").cast("bigint").alias("frame_no"), "class")
    return _read_back(spark, sf, sinks.write_parquet, both, "parquet")


@query("k07_text_report", """
    WITH m AS (SELECT * FROM b_files f SEMI JOIN b_targets t ON f.md5 = t.md5)
    SELECT part, CAST(count(*) AS BIGINT) AS blocks FROM (
      SELECT 0 AS part UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
      UNION ALL SELECT CASE WHEN deleted THEN 2 ELSE 1 END FROM m
      UNION ALL SELECT 3 FROM b_files f SEMI JOIN b_targets t ON f.sha256 = t.sha256
      UNION ALL SELECT 4 FROM b_usb WHERE line LIKE '%usb 1-1: idVendor%') u GROUP BY part""")
def _(spark, sf):
    files, targets = conform(_files(spark, sf), FILES), _targets(spark, sf)
    found = disk.match_files(files, targets, use_fuzzy=False)
    carried = match.network_matches(files, targets).withColumnRenamed("path", "name")
    devices = usb.usb_events(usb.linux_usb_events(bridge(spark, sf, "b_usb")))
    report = disk.DiskTriage(files, found, carried, devices).text_report()
    return report.groupBy("part").agg(F.count(F.lit(1)).alias("blocks"))


def _block(**fields: str) -> str:
    """SQL of the lines of one block of the text report, with the rule below."""
    lines = [f"'{label.replace('_', ' '):<11}: ' || coalesce(CAST({value} AS STRING), 'N/A')" for label, value in fields.items()]
    return " || chr(10) || ".join([*lines, f"'{sinks.RULE}'"])


def _head(part: int, title: str, table: str, none: str) -> str:
    return f"""SELECT {part} AS part, 0 AS step, '' AS key, '{title}' || chr(10) || '{sinks.RULE}'
      || CASE WHEN (SELECT count(*) FROM {table}) = 0 THEN chr(10) || '{none}' ELSE '' END AS text"""


_MATCH_BLOCK = _block(Path="path", Size="CAST(size AS STRING) || ' bytes'", Modified="NULL", Type="ftype", SHA256="sha256",
                      MD5="md5", Match_Type="mt")


@query("k07_report_text", f"""
    WITH m AS (SELECT *, CASE WHEN sha256 IN (SELECT sha256 FROM b_targets WHERE sha256 IS NOT NULL) THEN 'sha256' ELSE 'md5' END AS mt
      FROM b_files WHERE sha256 IN (SELECT sha256 FROM b_targets WHERE sha256 IS NOT NULL) OR md5 IN (SELECT md5 FROM b_targets)),
    n AS (SELECT * FROM b_files WHERE sha256 IN (SELECT sha256 FROM b_targets WHERE sha256 IS NOT NULL)),
    u AS (SELECT * FROM b_usb WHERE line LIKE '%usb 1-1: idVendor%'),
    ma AS (SELECT * FROM m WHERE NOT deleted), md AS (SELECT * FROM m WHERE deleted)
    SELECT 0 AS part, 0 AS step, '' AS key, 'FORENSIC ANALYSIS REPORT' || chr(10) || 'SUMMARY' || chr(10) || '{sinks.RULE}' || chr(10)
      || 'Matching allocated files : ' || (SELECT count(*) FROM ma) || chr(10) || 'Matching deleted files   : ' || (SELECT count(*) FROM md)
      || chr(10) || 'Suspicious network events: ' || (SELECT count(*) FROM n) || chr(10) || 'USB history entries      : '
      || (SELECT count(*) FROM u) || chr(10) || '{sinks.RULE}' AS text
    UNION ALL {_head(1, 'ALLOCATED FILE MATCHES', 'ma', 'No matching allocated file matches found.')}
    UNION ALL {_head(2, 'DELETED FILE MATCHES', 'md', 'No matching deleted file matches found.')}
    UNION ALL {_head(3, 'NETWORK EXFILTRATION MATCHES', 'n', 'No suspicious network events found.')}
    UNION ALL {_head(4, 'USB HISTORY', 'u', 'No USB activity detected.')}
    UNION ALL SELECT CASE WHEN deleted THEN 2 ELSE 1 END, 1, path, {_MATCH_BLOCK} FROM m
    UNION ALL SELECT 3, 1, path, {_block(Name='path', Size='size', SHA256='sha256', File_Type='ftype')} FROM n""")
def _(spark, sf):
    """The text of the report: summary, matches and network events in full, of the USB history its head."""
    files, targets = conform(_files(spark, sf), FILES), _targets(spark, sf)
    found = disk.match_files(files, targets, use_fuzzy=False)
    carried = match.network_matches(files, targets).withColumnRenamed("path", "name")
    devices = usb.usb_events(usb.linux_usb_events(bridge(spark, sf, "b_usb")))
    report = disk.DiskTriage(files, found, carried, devices).text_report()
    return report.filter("part < 4 OR step = 0").select("part", "step", "key", "text")


@query("k08_matched_content", "SELECT path, sha256 FROM b_files f SEMI JOIN b_targets t ON f.md5 = t.md5")
def _(spark, sf):
    path = work_path(spark, "content")
    found = match.hash_match(_files(spark, sf), _targets(spark, sf), "md5")
    sinks.export_content(found, contents(spark, sf), path)
    back = spark.read.schema("path string, content binary").parquet(path)
    return back.select(F.concat(F.lit("/"), F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"))


@query("k08_content_files", "SELECT path, sha256 FROM b_files f SEMI JOIN b_targets t ON f.md5 = t.md5")
def _(spark, sf):
    """Content of the matched files as files, read back."""
    path = work_path(spark, "content-files")
    found = match.hash_match(_files(spark, sf), _targets(spark, sf), "md5")
    write_content_files(found.select("path").join(contents(spark, sf).select("path", "content"), "path"), path)
    return read_content_files(spark, path).select(
        F.concat(F.lit("/"), F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"))


@query("k10_object_files", "SELECT frame_no, sha256(text) AS sha256 FROM b_mime WHERE turn % 4 = 0")
def _(spark, sf):
    """Carried files as files named by their frame, read back."""
    from egresslens.operators.objects import extract_objects
    path = work_path(spark, "object-files")
    carried = extract_objects(packets(spark, sf, "b_mime"), "multipart")
    write_content_files(carried.select(F.concat(F.col("frame_no").cast("string"), F.lit("/"), F.col("original_filename")).alias("path"),
                                       F.col("payload").alias("content")), path)
    return read_content_files(spark, path).select(
        F.regexp_extract("path", "^([0-9]+)/", 1).cast("bigint").alias("frame_no"), F.sha2("content", 256).alias("sha256"))


@query("k10_saved_objects", "SELECT frame_no, role || '.txt' AS original_filename, sha256(text) AS sha256 FROM b_mime WHERE turn % 4 = 0")
def _(spark, sf):
    from egresslens.operators.objects import extract_objects
    carried = extract_objects(packets(spark, sf, "b_mime"), "multipart")
    back = _read_back(spark, sf, sinks.write_parquet, carried, "parquet")
    return back.select("frame_no", "original_filename", F.sha2("payload", 256).alias("sha256"))
