"""Domain tables derived from the driver's tables, so that a second engine can check results.

Each bridge is one SQL text both engines accept; ``{sha}`` stands for the sha256 of ``text``.
"""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from egresslens.schemas import PACKETS, conform, layer

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
HOST = "10.0.0.1"
CRLF = "chr(13) || chr(10)"
START = 1_600_000_000

BRIDGES = {
    "b_packets": """
        SELECT l_orderkey AS frame_no, CAST(l_linenumber AS BIGINT) AS sub_no, l_shipdate AS ts,
               CAST(floor(l_extendedprice) AS BIGINT) AS length,
               '10.0.0.' || CAST(l_suppkey % 8 AS STRING) AS src,
               '203.0.113.' || CAST(l_partkey % 50 AS STRING) AS dst,
               CAST(l_partkey % 90 AS INT) AS sport, CAST(l_suppkey % 60 AS INT) AS dport
        FROM lineitem""",
    "b_http": """
        SELECT o_orderkey AS frame_no, o_orderdate AS ts,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'POST' WHEN o_orderpriority LIKE '2%' THEN 'put' ELSE 'GET' END AS request_method,
               CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice * 20) AS BIGINT) AS STRING) END AS content_length,
               CAST(floor(o_totalprice / 100) AS BIGINT) AS length,
               '10.0.0.' || CAST(o_custkey % 8 AS STRING) AS src,
               '203.0.113.' || CAST(o_orderkey % 50 AS STRING) AS dst
        FROM orders""",
    "b_ftp": """
        SELECT o_orderkey AS frame_no, o_orderdate AS ts,
               CASE o_orderstatus WHEN 'F' THEN 'stor' WHEN 'O' THEN 'RETR' ELSE 'USER' END AS request_command,
               'f' || CAST(o_custkey AS STRING) || '.bin' AS request_arg,
               CAST(floor(o_totalprice / 100) AS BIGINT) AS length,
               '10.0.0.' || CAST(o_custkey % 8 AS STRING) AS src,
               '198.51.100.' || CAST(o_orderkey % 20 AS STRING) AS dst
        FROM orders""",
    "b_smb": """
        SELECT l_orderkey AS frame_no, l_shipdate AS ts, l_linenumber AS n,
               CASE l_linenumber WHEN 1 THEN '0xa2' WHEN 2 THEN '0x2f' WHEN 3 THEN '0x2e' END AS smb_cmd,
               CASE l_linenumber WHEN 4 THEN '5' WHEN 5 THEN '9' WHEN 6 THEN '8' END AS smb2_cmd,
               ' p' || CAST(l_partkey AS STRING) || '.doc ' AS name,
               CAST(CAST(floor(l_extendedprice * 150) AS BIGINT) AS STRING) AS data_len,
               '10.0.0.' || CAST(l_suppkey % 8 AS STRING) AS src,
               '192.0.2.' || CAST(l_partkey % 10 AS STRING) AS dst
        FROM lineitem""",
    "b_dns": """
        SELECT p.page_id AS frame_no, e.ts AS ts,
               CASE WHEN p.page_id % 9 = 0 THEN '1' ELSE '0' END AS qr,
               CASE WHEN p.page_id % 5 = 0
                    THEN md5(p.url) || '-' || md5(p.html) || '.' || regexp_extract(p.url, '^https?://([^/?#]+)', 1) || '.'
                    ELSE regexp_extract(p.url, '^https?://([^/?#]+)', 1) END AS qname,
               '10.0.0.' || CAST(p.page_id % 8 AS STRING) AS src,
               '192.0.2.53' AS dst
        FROM pages p LEFT JOIN events e ON e.event_id = p.page_id""",
    "b_rr": """
        SELECT l_orderkey AS frame_no, CAST(l_linenumber AS BIGINT) AS rr_no,
               'q.d' || CAST(l_orderkey % 40 AS STRING) || '.com' AS qname,
               's' || CAST(l_suppkey AS STRING) || '.example.net' AS rr_name,
               CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 28 WHEN 2 THEN 2 WHEN 3 THEN 16 ELSE 99 END AS rr_type,
               CAST(l_quantity AS BIGINT) AS ttl,
               '198.51.' || CAST(l_suppkey % 200 AS STRING) || '.' || CAST(l_partkey % 20 AS STRING) AS rdata
        FROM lineitem""",
    "b_geo": """
        SELECT CAST(n_nationkey * 4 AS BIGINT) AS lo, CAST(n_nationkey * 4 + 3 AS BIGINT) AS hi,
               substr(n_name, 1, 2) AS iso, 'AS' || CAST(n_regionkey AS STRING) AS asn
        FROM nation""",
    "b_files": """
        SELECT doc_id, '/' || source || '/' || CAST(doc_id AS STRING) AS path, CAST(length(text) AS BIGINT) AS size,
               {sha} AS sha256, md5(text) AS md5, doc_id % 7 = 0 AS deleted,
               (doc_id % 3) * 1048576 AS partition_offset, 'text/' || lang AS ftype
        FROM documents WHERE doc_id % 5 <> 0""",
    "b_targets": """
        SELECT doc_id, '/targets/' || CAST(doc_id AS STRING) AS path,
               CASE WHEN doc_id % 2 = 0 THEN {sha} END AS sha256, md5(text) AS md5, 'text/' || lang AS ftype
        FROM documents WHERE doc_id % 5 = 0""",
    "b_tftp": """
        SELECT conv_id, turn + 1 AS block, conv_id * 1000 + turn + 1 AS frame_no,
               '10.0.0.' || CAST(conv_id % 8 AS STRING) AS src, '192.0.2.' || CAST(conv_id AS STRING) AS dst,
               CAST(40000 + conv_id AS INT) AS srcport, 'f' || CAST(conv_id % 20 AS STRING) || '.txt' AS filename, text
        FROM conversations""",
    "b_usb": """
        SELECT 'u' || CAST(user_id AS STRING) AS file, event_id AS line_no,
               CASE event_type
                 WHEN 'signup' THEN 'Jan  3 10:11:12 h kernel: usb 1-1: idVendor=' || CAST(event_id % 97 AS STRING) || ', idProduct=' || CAST(event_id % 89 AS STRING)
                 WHEN 'error' THEN 'Jan 13 10:11:13 h kernel: usb 1-1: SerialNumber=S' || CAST(event_id AS STRING)
                 WHEN 'purchase' THEN 'Jan 13 10:11:14 h kernel: usb 1-1: Manufacturer=M' || CAST(event_id % 11 AS STRING)
                 ELSE 'Jan 13 10:11:15 h sshd: idVendor=ignored' END AS line
        FROM events""",
    "b_scores": """
        SELECT l.doc_id AS frame_no, l.toxic AS y, CAST(d.n_chars % 1000 AS DOUBLE) / 1000 AS p1,
               CASE WHEN l.doc_id % 3 <> 0 THEN CAST((d.n_chars * 7) % 1000 AS DOUBLE) / 1000 END AS p2,
               d.lang AS lang, d.source AS source, CAST(d.n_chars AS DOUBLE) AS chars
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "b_mime": f"""
        SELECT conv_id * 1000 + turn AS frame_no, conv_id, turn, role, text,
               'multipart/form-data; boundary=----B' || CAST(conv_id AS STRING) AS content_type,
               '------B' || CAST(conv_id AS STRING) || {CRLF}
               || 'Content-Disposition: form-data; name="f"; filename="' || role || '.txt"'
               || {CRLF} || {CRLF} || text || {CRLF}
               || '------B' || CAST(conv_id AS STRING) || '--' || {CRLF} AS body,
               '10.0.0.' || CAST(conv_id % 8 AS STRING) AS src, '203.0.113.' || CAST(turn AS STRING) AS dst
        FROM conversations""",
}


def bridge_sql(name: str, engine: str) -> str:
    sha = "sha2(text, 256)" if engine == "spark" else "sha256(text)"
    return BRIDGES[name].replace("{sha}", sha)


def oracle(sql: str) -> str:
    """Put the definitions of the bridges a statement names in front of it."""
    used = [n for n in BRIDGES if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} AS ({bridge_sql(n, 'duckdb')})" for n in used]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(heads + [body[5:]])
    return ("WITH " + ", ".join(heads) + " " if heads else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bridge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = bridge_sql(name, "spark")
    for source in TABLES:
        if re.search(rf"\b{source}\b", sql):
            table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(sql)


def _ip():
    return layer("ip", src=F.col("src"), dst=F.col("dst"))


def packets(spark, sf_dir, name: str = "b_packets") -> DataFrame:
    """A bridge as packets with the layers it describes."""
    df = bridge(spark, sf_dir, name)
    return {"b_packets": _plain, "b_http": _http, "b_ftp": _ftp, "b_smb": _smb, "b_dns": _dns,
            "b_rr": _responses, "b_mime": _uploads}[name](df)


def _plain(df):
    return conform(df, PACKETS, ip=_ip(), udp=layer("udp", srcport=F.col("sport"), dstport=F.col("dport")))


def _http(df):
    return conform(df, PACKETS, ip=_ip(), http=layer(
        "http", request_method=F.col("request_method"), content_length=F.col("content_length")))


def _ftp(df):
    return conform(df, PACKETS, ip=_ip(), ftp=layer(
        "ftp", request_command=F.col("request_command"), request_arg=F.col("request_arg")))


def _smb(df):
    old = layer("smb", cmd=F.col("smb_cmd"), nt_create_andx_filename=F.col("name"), file_name=F.col("name"),
                data_len=F.col("data_len"))
    new = layer("smb2", cmd=F.col("smb2_cmd"), filename=F.col("name"), write_length=F.col("data_len"))
    return conform(df, PACKETS, ip=_ip(), smb=F.when(F.col("smb_cmd").isNotNull(), old),
                   smb2=F.when(F.col("smb2_cmd").isNotNull(), new))


def _dns(df):
    return conform(df, PACKETS, ip=_ip(), udp=layer("udp", srcport=F.lit(5353), dstport=F.lit(53)),
                   dns=layer("dns", qr=F.col("qr"), qname=F.col("qname")))


def _responses(df):
    """One packet per frame with its records in a fixed order."""
    record = F.struct("rr_no", "rr_type", "rr_name", "ttl", "rdata")
    grouped = df.groupBy("frame_no", "qname").agg(F.array_sort(F.collect_list(record)).alias("records"))
    rr = F.transform("records", lambda r: F.struct(
        F.lit("an").alias("section"), r["rr_name"].alias("name"), r["rr_type"].cast("int").alias("type"),
        r["ttl"].alias("ttl"), r["rdata"].alias("rdata")))
    return conform(grouped, PACKETS, udp=layer("udp", srcport=F.lit(53), dstport=F.lit(5353)),
                   dns=layer("dns", qr=F.lit("1"), qname=F.col("qname"), rr=rr))


def _uploads(df):
    """By turn: a multipart upload, a wrapped body without boundary header, a response, a mail."""
    kind = F.col("turn") % 4
    hexed = F.hex(F.col("body"))
    http = F.when(kind == 0, layer("http", request_method=F.lit("POST"), content_type=F.col("content_type"), file_data=hexed)) \
        .when(kind == 1, layer("http", request_method=F.lit("POST"), content_type=F.lit("multipart/form-data"), file_data=hexed)) \
        .when(kind == 2, layer("http", response_code=F.lit("200"), file_data=F.hex("text"), content_disposition=F.concat(
            F.lit('attachment; filename="'), F.col("role"), F.lit('.bin"'))))
    return conform(df, PACKETS, ip=_ip(), http=http, length=F.octet_length("text"),
                   smtp=F.when(kind == 3, layer("smtp", command=mail_command(), data=F.hex(mail_text()))))


def mail_command():
    return F.when(F.col("role") == "user", "mail FROM:<a@b>").otherwise("RCPT TO:<c@d>")


def mail_text():
    """Even conversations attach named text, odd ones unnamed base64."""
    mark = F.concat(F.lit("M"), F.col("conv_id").cast("string"))
    head = F.concat(F.lit('Subject: x\r\nContent-Type: multipart/mixed; boundary="'), mark, F.lit('"\r\n\r\n--'), mark, F.lit("\r\n"))
    named = F.concat(F.lit('Content-Disposition: attachment; filename="'), F.col("role"), F.lit('.eml"\r\n\r\n'), F.col("text"))
    coded = F.concat(F.lit("Content-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.encode("text", "UTF-8")))
    return F.concat(head, F.when(F.col("conv_id") % 2 == 0, named).otherwise(coded), F.lit("\r\n--"), mark, F.lit("--\r\n"))


def tftp_packets(spark, sf_dir, shared: bool = False) -> DataFrame:
    """Write requests and data blocks; ``shared`` lets transfers of a client mix on one server."""
    blocks = bridge(spark, sf_dir, "b_tftp")
    if shared:
        blocks = blocks.withColumn("dst", F.lit("192.0.2.1"))
    udp = layer("udp", srcport=F.col("srcport"), dstport=F.lit(69))
    request = conform(
        blocks.groupBy("conv_id", "src", "dst", "srcport", "filename").agg(F.min("frame_no").alias("first")),
        PACKETS, frame_no=F.col("first") - 1, ip=_ip(), udp=udp,
        ts=F.timestamp_seconds(F.col("first") + START - 1), length=F.lit(60),
        tftp=layer("tftp", opcode=F.lit("2"), filename=F.col("filename")))
    data = conform(
        blocks, PACKETS, ip=_ip(), udp=udp, ts=F.timestamp_seconds(F.col("frame_no") + START), length=F.octet_length("text"),
        tftp=layer("tftp", opcode=F.lit("3"), block=F.col("block").cast("string"), data=F.hex("text")))
    return request.unionByName(data)


def contents(spark, sf_dir) -> DataFrame:
    """Documents as files with content."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"), (F.col("doc_id") % 7 == 0).alias("deleted"),
        ((F.col("doc_id") % 3) * 1048576).alias("partition_offset"), F.encode("text", "UTF-8").alias("content"))
