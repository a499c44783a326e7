"""Registered queries over packets: filters, counters, detectors, carried files, transfers."""

from pyspark.sql import functions as F

from egresslens import constants as C
from egresslens.functions.text import human_bytes
from egresslens.operators import detect, filters, objects, reassembly, totals
from egresslens.operators.ordered import numbered
from egresslens.plans import network
from egresslens.plans.bridges import CRLF, HOST, bridge, packets, tftp_packets
from egresslens.plans.registry import query
from egresslens.schemas import FINDING

H = f"'{HOST}'"
LIMIT = C.LARGE_UPLOAD_BYTES

# --- filters -----------------------------------------------------------------------------------


@query("f01_host_filter", f"SELECT frame_no, src, dst, length FROM b_packets WHERE src = {H} OR dst = {H}")
def _(spark, sf):
    seen = filters.host_filter(packets(spark, sf), HOST)
    return seen.select("frame_no", "ip.src", "ip.dst", "length")


@query("f02_expression_filter", "SELECT frame_no, length FROM b_packets WHERE length > 50000 AND dport < 10")
def _(spark, sf):
    return filters.expression_filter(packets(spark, sf), "length > 50000 AND udp.dstport < 10").select("frame_no", "length")


@query("f03_drop_smb_reads", """
    SELECT frame_no, smb_cmd, smb2_cmd FROM b_smb
    WHERE NOT (coalesce(smb_cmd, '') = '0x2e' OR coalesce(smb2_cmd, '') = '8')""")
def _(spark, sf):
    kept = filters.drop_smb_reads(packets(spark, sf, "b_smb"))
    return kept.select("frame_no", F.col("smb.cmd").alias("smb_cmd"), F.col("smb2.cmd").alias("smb2_cmd"))


@query("f04_dns_port_filter", "SELECT frame_no, qname FROM b_dns")
def _(spark, sf):
    mixed = packets(spark, sf, "b_dns").unionByName(packets(spark, sf, "b_packets"))
    return filters.dns_port_filter(mixed).select("frame_no", "dns.qname")


@query("f05_layer_present", "SELECT frame_no, n FROM (SELECT frame_no, 'ftp' AS n FROM b_ftp UNION ALL SELECT frame_no, 'dns' AS n FROM b_dns) u")
def _(spark, sf):
    mixed = packets(spark, sf, "b_ftp").unionByName(packets(spark, sf, "b_dns")).unionByName(packets(spark, sf))
    return filters.has_layer(mixed, "ftp", "dns").select(
        "frame_no", F.when(F.col("ftp").isNotNull(), "ftp").otherwise("dns").alias("n"))


@query("f06_dns_queries", "SELECT frame_no, qname FROM b_dns WHERE qr = '0'")
def _(spark, sf):
    return filters.dns_queries(packets(spark, sf, "b_dns")).select("frame_no", "dns.qname")


@query("f10_direction", f"""
    SELECT CASE WHEN src = {H} THEN 'out' WHEN dst = {H} THEN 'in' END AS direction,
           CAST(count(*) AS BIGINT) AS frames, CAST(sum(length) AS BIGINT) AS bytes FROM b_packets GROUP BY 1""")
def _(spark, sf):
    return packets(spark, sf).groupBy(filters.direction(HOST).alias("direction")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("length").alias("bytes"))


# --- counters ----------------------------------------------------------------------------------


def mixed_packets(spark, sf):
    names = ["b_packets", "b_http", "b_ftp", "b_smb", "b_dns", "b_mime"]
    parts = [packets(spark, sf, n) for n in names] + [tftp_packets(spark, sf)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("a01_totals", f"""
    WITH lens AS (
      SELECT src, dst, length FROM b_packets UNION ALL SELECT src, dst, length FROM b_http
      UNION ALL SELECT src, dst, length FROM b_ftp UNION ALL SELECT src, dst, NULL FROM b_smb
      UNION ALL SELECT src, dst, NULL FROM b_dns UNION ALL SELECT src, dst, strlen(text) FROM b_mime
      UNION ALL SELECT src, dst, strlen(text) FROM b_tftp
      UNION ALL SELECT DISTINCT src, dst, 60 + 0 * conv_id FROM b_tftp)
    SELECT CAST((SELECT count(*) FROM lens) AS BIGINT) AS frames,
      CAST((SELECT sum(length) FROM lens WHERE src = {H}) AS BIGINT) AS bytes_from_host,
      CAST((SELECT coalesce(sum(length), 0) FROM lens WHERE dst = {H}) AS BIGINT) AS bytes_to_host,
      CAST((SELECT count(*) FROM b_http WHERE upper(request_method) = 'POST')
           + (SELECT count(*) FROM b_mime WHERE turn % 4 < 2) AS BIGINT) AS http_posts,
      CAST((SELECT count(*) FROM b_http WHERE upper(request_method) = 'PUT') AS BIGINT) AS http_puts,
      CAST((SELECT count(*) FROM b_ftp WHERE upper(request_command) = 'STOR' AND src = {H}) AS BIGINT) AS ftp_stor,
      CAST((SELECT count(DISTINCT conv_id) FROM b_tftp WHERE src = {H}) AS BIGINT) AS tftp_wrq,
      CAST((SELECT count(*) FROM b_smb WHERE src = {H} AND n IN (1, 2, 4, 5)) AS BIGINT) AS smb_write_create,
      CAST((SELECT count(*) FROM b_dns WHERE qr = '0') AS BIGINT) AS dns_queries,
      CAST((SELECT count(*) FROM b_dns WHERE qr = '0' AND length(rtrim(qname, '.')) > 50) AS BIGINT) AS dns_suspected_tunnel,
      CAST((SELECT count(*) FROM b_mime WHERE turn % 4 = 3) AS BIGINT) AS smtp_frames,
      CAST((SELECT count(*) FROM b_mime WHERE turn % 4 = 3 AND role = 'user' AND src = {H}) AS BIGINT) AS smtp_mail_from,
      CAST((SELECT count(*) FROM b_mime WHERE turn % 4 = 3 AND role <> 'user' AND src = {H}) AS BIGINT) AS smtp_rcpt_to,
      CAST((SELECT count(*) FROM b_mime WHERE turn % 4 = 3) AS BIGINT) AS smtp_attachments_saved""")
def _(spark, sf):
    return totals.totals(mixed_packets(spark, sf), HOST)


@query("a02_http_methods", """
    SELECT CAST(count(*) FILTER (WHERE upper(request_method) = 'POST') AS BIGINT) AS http_posts,
           CAST(count(*) FILTER (WHERE upper(request_method) = 'PUT') AS BIGINT) AS http_puts FROM b_http""")
def _(spark, sf):
    return totals.http_method_counts(packets(spark, sf, "b_http"))


_OUTBOUND = f"SELECT dst, CAST(sum(length) AS BIGINT) AS bytes FROM b_packets WHERE src = {H} GROUP BY dst"


@query("a03_outbound_by_destination", _OUTBOUND)
def _(spark, sf):
    return totals.outbound_by_destination(packets(spark, sf), HOST)


@query("t01_ranked_destinations", _OUTBOUND + " ORDER BY bytes DESC, dst")
def _(spark, sf):
    return totals.ranked_destinations(totals.outbound_by_destination(packets(spark, sf), HOST))


@query("t02_top_destinations", _OUTBOUND + " ORDER BY bytes DESC, dst LIMIT 10")
def top_destinations(spark, sf):
    return totals.top_destinations(
        totals.outbound_by_destination(packets(spark, sf), HOST), C.SUMMARY_TOP_DESTINATIONS)


# --- detectors ---------------------------------------------------------------------------------

_KEYS = ["frame_no", "proto", "command", "method", "src", "dst", "filename", "content_length", "size", "qname", "note"]


def _found(df, *columns):
    return df.select(*columns)


_D1 = f"""SELECT frame_no, 'HTTP' AS proto, upper(request_method) AS method, src, dst,
    TRY_CAST(content_length AS BIGINT) AS content_length, '{C.NOTE_HTTP_LARGE}' AS note
    FROM b_http WHERE src = {H} AND TRY_CAST(content_length AS BIGINT) >= {LIMIT}"""


@query("d01_large_http_request", _D1)
def _(spark, sf):
    return detect.findings(packets(spark, sf, "b_http"), detect.large_http(HOST)).select(
        "frame_no", "proto", "method", "src", "dst", "content_length", "note")


_SHA_TRIM = r"sha256(regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g'))"


def _saved(spark, sf, rule):
    found = objects.extract_objects(packets(spark, sf, "b_mime"), rule)
    return found.select("frame_no", "original_filename", "size", "sha256", "proto", "note",
                        F.col("pkt.src").alias("src"), F.col("pkt.method").alias("method"))


@query("d02_multipart_upload", f"""
    SELECT frame_no, role || '.txt' AS original_filename, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256,
           'HTTP' AS proto, '{C.NOTE_HTTP_MULTIPART}' AS note, src, 'POST' AS method FROM b_mime WHERE turn % 4 = 0""")
def _(spark, sf):
    return _saved(spark, sf, "multipart")


@query("d03_peeled_upload", f"""
    SELECT frame_no, role || '.txt' AS original_filename,
           CAST(strlen(regexp_replace(text, '^[\\r\\n]+|[\\r\\n]+$', '', 'g')) AS BIGINT) AS size, {_SHA_TRIM} AS sha256,
           'HTTP' AS proto, '{C.NOTE_HTTP_PEELED}' AS note, src, 'POST' AS method FROM b_mime WHERE turn % 4 = 1""")
def _(spark, sf):
    return _saved(spark, sf, "peeled")


@query("d04_response_download", f"""
    SELECT frame_no, role || '.bin' AS original_filename, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256,
           'HTTP' AS proto, '{C.NOTE_HTTP_RESPONSE}' AS note, src, CAST(NULL AS STRING) AS method FROM b_mime WHERE turn % 4 = 2""")
def _(spark, sf):
    return _saved(spark, sf, "response")


@query("d05_disposition_seen", f"""
    SELECT frame_no, 'HTTP' AS proto, src, dst, role || '.bin' AS filename, '{C.NOTE_HTTP_DISPOSITION}' AS note
    FROM b_mime WHERE turn % 4 = 2""")
def _(spark, sf):
    return detect.findings(packets(spark, sf, "b_mime"), detect.disposition_seen()).select(
        "frame_no", "proto", "src", "dst", "filename", "note")


@query("d06_ftp_upload", f"""
    SELECT frame_no, 'STOR' AS command, src, dst, request_arg AS filename, '{C.NOTE_FTP_STOR}' AS note
    FROM b_ftp WHERE upper(request_command) = 'STOR' AND src = {H}""")
def _(spark, sf):
    return detect.findings(packets(spark, sf, "b_ftp"), detect.ftp_upload(HOST)).select(
        "frame_no", "command", "src", "dst", "filename", "note")


@query("d07_ftp_filename", f"""
    SELECT frame_no, upper(request_command) AS command, src, dst, request_arg AS filename, '{C.NOTE_FTP_SEEN}' AS note
    FROM b_ftp WHERE upper(request_command) = 'RETR' OR (upper(request_command) = 'STOR' AND src <> {H})""")
def _(spark, sf):
    return detect.findings(packets(spark, sf, "b_ftp"), detect.ftp_filename(HOST)).select(
        "frame_no", "command", "src", "dst", "filename", "note")


@query("d08_tftp_write", f"""
    SELECT min(frame_no) - 1 AS frame_no, src, dst, filename, '{C.NOTE_TFTP_WRQ}' AS note
    FROM b_tftp WHERE src = {H} GROUP BY conv_id, src, dst, filename""")
def _(spark, sf):
    return detect.findings(tftp_packets(spark, sf), detect.tftp_write(HOST)).select(
        "frame_no", "src", "dst", "filename", "note")


_SMB = f"""
    SELECT frame_no, CASE WHEN n < 4 THEN 'SMB' ELSE 'SMB2' END AS proto,
      CASE n WHEN 1 THEN 'NT_CREATE_ANDX' WHEN 2 THEN 'WRITE_ANDX' WHEN 4 THEN 'CREATE' ELSE 'WRITE' END AS command,
      src, dst, CASE WHEN n <> 5 THEN trim(name) END AS filename,
      CASE WHEN n IN (2, 5) AND CAST(data_len AS BIGINT) >= {LIMIT} THEN CAST(data_len AS BIGINT) END AS content_length
    FROM b_smb WHERE src = {H} AND n IN (1, 2, 4, 5)"""


@query("d09_smb_write", f"""
    WITH s AS ({_SMB}) SELECT *, proto || ' file upload command (' || command || ') from host'
      || coalesce(' filename: ' || filename, '')
      || CASE WHEN content_length IS NOT NULL THEN '{C.NOTE_SMB_LARGE}' ELSE '' END AS note FROM s""")
def _(spark, sf):
    return detect.findings(packets(spark, sf, "b_smb"), detect.smb_write(HOST)).select(
        "frame_no", "proto", "command", "src", "dst", "filename", "content_length", "note")


@query("d10_large_smb_write", f"""
    WITH s AS ({_SMB}) SELECT frame_no, command, content_length FROM s WHERE content_length IS NOT NULL""")
def _(spark, sf):
    found = detect.findings(packets(spark, sf, "b_smb"), detect.smb_write(HOST))
    return found.filter(F.endswith("note", F.lit(C.NOTE_SMB_LARGE))).select("frame_no", "command", "content_length")


_MAIL = r"""
    SELECT frame_no, src, dst, CASE WHEN conv_id % 2 = 0 THEN role || '.eml' END AS named,
      CASE WHEN conv_id % 2 = 0 THEN encode(regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g'))
           WHEN length(b64) > 98 THEN encode(text)
           ELSE encode(CASE WHEN length(b64) > 76 THEN substr(b64, 1, 76) || chr(13) || chr(10) || substr(b64, 77) ELSE b64 END) END AS payload
    FROM (SELECT *, to_base64(encode(text)) AS b64 FROM b_mime) x WHERE turn % 4 = 3"""


@query("d11_smtp_attachment", f"""
    WITH m AS ({_MAIL}) SELECT frame_no, src, coalesce(named, 'smtp_attach_' || substr(sha256(payload), 1, 8) || '.bin') AS original_filename,
      CAST(octet_length(payload) AS BIGINT) AS size, sha256(payload) AS sha256, '{C.NOTE_SMTP_ATTACHMENT}' AS note FROM m""")
def _(spark, sf):
    found = objects.extract_objects(packets(spark, sf, "b_mime"), "attachment")
    return found.select("frame_no", F.col("pkt.src").alias("src"), "original_filename", "size", "sha256", "note")


def _plain_mail(spark, sf):
    from egresslens.schemas import PACKETS, conform, layer
    df = bridge(spark, sf, "b_mime")
    return conform(df, PACKETS, ip=layer("ip", src=F.col("src"), dst=F.col("dst")),
                   smtp=layer("smtp", data=F.hex(F.concat(F.lit("Subject: x\r\n\r\n"), F.col("text")))))


@query("d12_large_smtp", f"""
    SELECT frame_no, src, dst, CAST(strlen(text) + 14 AS BIGINT) AS size, '{C.NOTE_SMTP_LARGE}' AS note
    FROM b_mime WHERE src = {H} AND strlen(text) + 14 > 600""")
def _(spark, sf):
    # The bound is lowered to the size of the given texts.
    return detect.findings(_plain_mail(spark, sf), detect.large_smtp(HOST, 600)).select("frame_no", "src", "dst", "size", "note")


@query("d13_long_dns_name", f"""
    SELECT frame_no, src, dst, rtrim(qname, '.') AS qname, '{C.NOTE_DNS_LONG}' AS note
    FROM b_dns WHERE qr = '0' AND length(rtrim(qname, '.')) > 50""")
def _(spark, sf):
    return detect.findings(packets(spark, sf, "b_dns"), detect.long_dns_name()).select(
        "frame_no", "src", "dst", "qname", "note")


@query("d14_flow", f"""
    WITH t AS (SELECT CAST(sum(length) AS BIGINT) AS b FROM b_packets WHERE src = {H})
    SELECT 'FLOW' AS proto, '{C.NOTE_FLOW}' || CASE WHEN b < 1048576 * 1024 THEN format('{{:.1f}}MB', b / 1048576.0)
      ELSE format('{{:.1f}}GB', b / 1073741824.0) END AS note FROM t WHERE b > 5 * 1024 * 1024""")
def _(spark, sf):
    counters = totals.totals(packets(spark, sf), HOST, attachments=False)
    return detect.flow_finding(counters).select("proto", "note")


# --- transfers ---------------------------------------------------------------------------------

TRANSFERS_SQL = """
    WITH ends AS (SELECT conv_id, min(block) FILTER (WHERE strlen(text) < 512) AS stop FROM b_tftp GROUP BY conv_id),
    whole AS (
      SELECT b.conv_id, e.stop, any_value(b.src) AS src, any_value(b.filename) AS filename,
             min(b.frame_no) - 1 AS opened, count(*) AS blocks, string_agg(b.text, '' ORDER BY b.block) AS data,
             max(b.frame_no) AS last_frame
      FROM b_tftp b JOIN ends e ON e.conv_id = b.conv_id WHERE e.stop IS NULL OR b.block <= e.stop GROUP BY b.conv_id, e.stop)
"""


@query("w05_tftp_transfers", TRANSFERS_SQL + """
    SELECT src, opened, CASE WHEN stop IS NULL THEN 'incomplete_' ELSE '' END || filename AS original_filename,
           stop IS NOT NULL AS complete, CAST(blocks AS BIGINT) AS blocks, CAST(strlen(data) AS BIGINT) AS size, sha256(data) AS sha256
    FROM whole""")
def _(spark, sf):
    return reassembly.rebuild_transfers(tftp_packets(spark, sf)).select(
        "src", "opened", "original_filename", "complete", "blocks", "size", "sha256")


@query("j08_tftp_assignment", """
    WITH ends AS (SELECT conv_id, min(block) FILTER (WHERE strlen(text) < 512) AS stop FROM b_tftp GROUP BY conv_id)
    SELECT b.frame_no, b.src, b.srcport AS port, b.conv_id * 1000 AS opened, b.block, b.conv_id * 1000 + e.stop AS closed
    FROM b_tftp b JOIN ends e ON e.conv_id = b.conv_id WHERE e.stop IS NULL OR b.block <= e.stop""")
def _(spark, sf):
    events = reassembly.tftp_events(tftp_packets(spark, sf))
    return reassembly.assign_blocks(events).select("frame_no", "src", "port", "opened", "block", "closed")


@query("j08_tftp_shared_server")
def _(spark, sf):
    return reassembly.rebuild_transfers(tftp_packets(spark, sf, shared=True)).drop("payload")


@query("x18_ordered_concat", """
    SELECT conv_id, sha256(string_agg(text, '' ORDER BY block)) AS sha256 FROM b_tftp GROUP BY conv_id""")
def _(spark, sf):
    from egresslens.functions.binary import ordered_concat, sha256
    blocks = bridge(spark, sf, "b_tftp").groupBy("conv_id").agg(
        F.collect_list(F.struct("block", F.encode("text", "UTF-8").alias("data"))).alias("blocks"))
    return blocks.select("conv_id", sha256(ordered_concat(F.col("blocks"))).alias("sha256"))


@query("t03_sorted_blocks", """
    SELECT conv_id, CAST(to_json(list(block ORDER BY block)) AS STRING) AS blocks FROM b_tftp GROUP BY conv_id""")
def _(spark, sf):
    blocks = bridge(spark, sf, "b_tftp").groupBy("conv_id").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    return blocks.select("conv_id", F.to_json("blocks").alias("blocks"))


@query("d15_tftp_reconstructed", TRANSFERS_SQL + f"""
    SELECT 'TFTP' AS proto, CASE WHEN stop IS NULL THEN 'incomplete_' ELSE '' END || filename AS filename,
           CASE WHEN stop IS NULL THEN opened ELSE last_frame END AS frame_no, '{C.NOTE_TFTP_REBUILT}' AS note FROM whole""")
def _(spark, sf):
    rebuilt = reassembly.rebuild_transfers(tftp_packets(spark, sf))
    return reassembly.transfer_findings(rebuilt).select("proto", "filename", "frame_no", "note")


@query("a04_objects_by_protocol", """
    SELECT CASE WHEN turn % 4 = 3 THEN 'SMTP' ELSE 'HTTP' END AS proto, CAST(count(*) AS BIGINT) AS files FROM b_mime GROUP BY 1
    UNION ALL SELECT 'TFTP', CAST(count(DISTINCT conv_id) AS BIGINT) FROM b_tftp""")
def _(spark, sf):
    carried = objects.extract_objects(packets(spark, sf, "b_mime")).select("proto")
    rebuilt = reassembly.rebuild_transfers(tftp_packets(spark, sf)).select("proto")
    return totals.objects_by_protocol(carried.unionByName(rebuilt))


_NAMED = """
    WITH n AS (SELECT frame_no, role || '.txt' AS original_filename,
                      row_number() OVER (PARTITION BY role ORDER BY frame_no) AS rn, role FROM b_mime WHERE turn % 4 = 0)
    SELECT frame_no, original_filename, CASE WHEN rn = 1 THEN original_filename
      ELSE role || '(' || CAST(rn - 1 AS STRING) || ').txt' END AS saved_as FROM n"""


@query("w02_unique_names", _NAMED)
def _(spark, sf):
    carried = objects.extract_objects(packets(spark, sf, "b_mime"), "multipart").drop("payload")
    named = objects.unique_names(carried)
    return named.select("frame_no", "original_filename", F.col("filename").alias("saved_as"))


@query("u06_all_findings", f"""
    SELECT frame_no, proto, note FROM ({_D1}) a
    UNION ALL SELECT frame_no, 'FTP', CASE WHEN upper(request_command) = 'STOR' AND src = {H} THEN '{C.NOTE_FTP_STOR}' ELSE '{C.NOTE_FTP_SEEN}' END
      FROM b_ftp WHERE upper(request_command) IN ('STOR', 'RETR')
    UNION ALL SELECT frame_no, 'DNS', '{C.NOTE_DNS_LONG}' FROM b_dns WHERE qr = '0' AND length(rtrim(qname, '.')) > 50
    UNION ALL SELECT frame_no, 'HTTP', '{C.NOTE_HTTP_DISPOSITION}' FROM b_mime WHERE turn % 4 = 2
    UNION ALL SELECT min(frame_no) - 1, 'TFTP', '{C.NOTE_TFTP_WRQ}' FROM b_tftp WHERE src = {H} GROUP BY conv_id
    UNION ALL SELECT frame_no, proto, proto || ' file upload command (' || command || ') from host'
      || coalesce(' filename: ' || filename, '') || CASE WHEN content_length IS NOT NULL THEN '{C.NOTE_SMB_LARGE}' ELSE '' END FROM ({_SMB}) s""")
def all_findings(spark, sf):
    return detect.findings(mixed_packets(spark, sf), *detect.stateless_detectors(HOST)).select("frame_no", "proto", "note")


@query("t02_sample_findings", f"SELECT frame_no, note FROM ({_D1}) d ORDER BY frame_no LIMIT 20")
def _(spark, sf):
    found = detect.findings(packets(spark, sf, "b_http"), detect.large_http(HOST))
    return detect.sample_findings(found).select("frame_no", "note")


@query("d00_rejected_values", """
    SELECT CAST(count(*) FILTER (WHERE TRY_CAST(content_length AS BIGINT) IS NULL) AS BIGINT) AS http_content_length,
           CAST(0 AS BIGINT) AS tftp_opcode, CAST(0 AS BIGINT) AS smb_data_len, CAST(0 AS BIGINT) AS smb2_write_length,
           CAST(0 AS BIGINT) AS dns_qr FROM b_http""")
def _(spark, sf):
    return detect.rejects(packets(spark, sf, "b_http"))


@query("x06_human_bytes", """
    SELECT frame_no, length, CASE WHEN length < 1024 THEN format('{:.1f}B', CAST(length AS DOUBLE))
      WHEN length < 1048576 THEN format('{:.1f}KB', length / 1024.0) ELSE format('{:.1f}MB', length / 1048576.0) END AS human
    FROM b_packets""")
def _(spark, sf):
    return packets(spark, sf).select("frame_no", "length", human_bytes(F.col("length")).alias("human"))


@query("w06_time_order", "SELECT frame_no, ts FROM b_http ORDER BY ts, frame_no")
def _(spark, sf):
    return packets(spark, sf, "b_http").select("frame_no", "ts").orderBy("ts", "frame_no")


# --- everything together -----------------------------------------------------------------------

def _finding_row(source: str, **columns: str) -> str:
    """SELECT of one finding per row of ``source`` with all columns of a finding, those not given NULL."""
    kinds = {"bigint": "BIGINT", "string": "STRING", "double": "DOUBLE", "int": "INTEGER"}
    listed = [f"CAST({columns.get(f.name, 'NULL')} AS {kinds[f.dataType.simpleString()]}) AS {f.name}" for f in FINDING.fields]
    return f"SELECT {', '.join(listed)} FROM {source}"


_ENDS = dict(src="src", dst="dst", frame_no="frame_no")


def stateless_sql(where: str = "true") -> str:
    """Findings of single packets over the mixed packets, as SQL; ``where`` is a condition on their addresses."""
    tftp = f"(SELECT min(frame_no) - 1 AS frame_no, src, dst, filename FROM b_tftp WHERE src = {H} GROUP BY conv_id, src, dst, filename) t"
    smb_note = (f"proto || ' file upload command (' || command || ') from host' || coalesce(' filename: ' || filename, '') "
                f"|| CASE WHEN content_length IS NOT NULL THEN '{C.NOTE_SMB_LARGE}' ELSE '' END")
    stored = f"upper(request_command) = 'STOR' AND src = {H}"
    return " UNION ALL ".join([
        _finding_row(f"({_D1}) d1", **_ENDS, proto="'HTTP'", method="method", content_length="content_length", note="note"),
        _finding_row(f"b_ftp WHERE upper(request_command) IN ('STOR', 'RETR') AND {where}", **_ENDS, proto="'FTP'",
                     command="upper(request_command)", filename="request_arg",
                     note=f"CASE WHEN {stored} THEN '{C.NOTE_FTP_STOR}' ELSE '{C.NOTE_FTP_SEEN}' END"),
        _finding_row(f"b_dns WHERE qr = '0' AND length(rtrim(qname, '.')) > 50 AND {where}", **_ENDS, proto="'DNS'",
                     qname="rtrim(qname, '.')", note=f"'{C.NOTE_DNS_LONG}'"),
        _finding_row(f"b_mime WHERE turn % 4 = 2 AND {where}", **_ENDS, proto="'HTTP'", filename="role || '.bin'",
                     note=f"'{C.NOTE_HTTP_DISPOSITION}'"),
        _finding_row(tftp, **_ENDS, proto="'TFTP'", command="'WRQ'", filename="filename", note=f"'{C.NOTE_TFTP_WRQ}'"),
        _finding_row(f"({_SMB}) s", **_ENDS, proto="proto", command="command", filename="filename",
                     content_length="content_length", note=smb_note)])


#: Carried files of the mixed packets, with the name each is saved under, and transfers from the host likewise.
_CARRIED_SQL = TRANSFERS_SQL.rstrip() + rf""",
    mail AS ({_MAIL}),
    files AS (
      SELECT frame_no, src, dst, 'HTTP' AS proto, role || CASE WHEN turn % 4 = 2 THEN '.bin' ELSE '.txt' END AS name,
             encode(CASE WHEN turn % 4 = 1 THEN regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g') ELSE text END) AS payload,
             CASE turn % 4 WHEN 0 THEN '{C.NOTE_HTTP_MULTIPART}' WHEN 1 THEN '{C.NOTE_HTTP_PEELED}' ELSE '{C.NOTE_HTTP_RESPONSE}' END AS note
      FROM b_mime WHERE turn % 4 < 3
      UNION ALL
      SELECT frame_no, src, dst, 'SMTP', coalesce(named, 'smtp_attach_' || substr(sha256(payload), 1, 8) || '.bin'), payload,
             '{C.NOTE_SMTP_ATTACHMENT}' FROM mail
      UNION ALL
      SELECT CASE WHEN stop IS NULL THEN opened ELSE last_frame END, src, NULL, 'TFTP',
             CASE WHEN stop IS NULL THEN 'incomplete_' ELSE '' END || filename, encode(data), NULL FROM whole),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY proto, name ORDER BY frame_no) - 1 AS copy FROM files WHERE src = {H}),
    carried AS (SELECT *, CASE WHEN copy = 0 THEN name ELSE
      regexp_replace(name, '(\.[^.]+)$', '(' || CAST(copy AS STRING) || ')\1') END AS saved FROM ranked)"""

_LENGTHS = """
    lens AS (
      SELECT src, dst, length FROM b_packets UNION ALL SELECT src, dst, length FROM b_http
      UNION ALL SELECT src, dst, length FROM b_ftp UNION ALL SELECT src, dst, NULL FROM b_smb
      UNION ALL SELECT src, dst, NULL FROM b_dns UNION ALL SELECT src, dst, strlen(text) FROM b_mime
      UNION ALL SELECT src, dst, strlen(text) FROM b_tftp
      UNION ALL SELECT DISTINCT src, dst, 60 + 0 * conv_id FROM b_tftp)"""

_SENT = f"(SELECT CAST(sum(length) AS BIGINT) AS b FROM lens WHERE src = {H})"
_TRIAGE_SQL = f"""{_CARRIED_SQL}, {_LENGTHS},
    found AS ({stateless_sql(f"src = {H}")}
      UNION ALL {_finding_row("carried WHERE proto <> 'TFTP'", **_ENDS, proto="proto", filename="name", saved_as="saved", note="note")}
      UNION ALL {_finding_row("carried WHERE proto = 'TFTP'", frame_no="frame_no", proto="proto", filename="saved", note=f"'{C.NOTE_TFTP_REBUILT}'")}
      UNION ALL {_finding_row(f"{_SENT} t WHERE b > 5 * 1024 * 1024", proto="'FLOW'", note=f"'{C.NOTE_FLOW}' || CASE WHEN b < 1048576 * 1024 THEN format('{{:.1f}}MB', b / 1048576.0) ELSE format('{{:.1f}}GB', b / 1073741824.0) END")})
"""


@query("network_triage", _TRIAGE_SQL + "SELECT * FROM found")
def _(spark, sf):
    return network.run(mixed_packets(spark, sf), HOST).findings


def _counted(condition: str, table: str, counted: str = "count(*)") -> str:
    return f"(SELECT {counted} FROM {table} WHERE {condition})"


_TOTALS = {
    "frames": _counted(f"src = {H}", "lens"), "bytes_from_host": f"(SELECT b FROM {_SENT} x)", "bytes_to_host": "0",
    "http_posts": _counted(f"upper(request_method) = 'POST' AND src = {H}", "b_http") + " + " + _counted(f"turn % 4 < 2 AND src = {H}", "b_mime"),
    "http_puts": _counted(f"upper(request_method) = 'PUT' AND src = {H}", "b_http"),
    "ftp_stor": _counted(f"upper(request_command) = 'STOR' AND src = {H}", "b_ftp"),
    "tftp_wrq": _counted(f"src = {H}", "b_tftp", "count(DISTINCT conv_id)"),
    "smb_write_create": _counted(f"src = {H} AND n IN (1, 2, 4, 5)", "b_smb"),
    "dns_queries": _counted(f"qr = '0' AND src = {H}", "b_dns"),
    "dns_suspected_tunnel": _counted(f"qr = '0' AND length(rtrim(qname, '.')) > 50 AND src = {H}", "b_dns"),
    "smtp_frames": _counted(f"turn % 4 = 3 AND src = {H}", "b_mime"),
    "smtp_mail_from": _counted(f"turn % 4 = 3 AND role = 'user' AND src = {H}", "b_mime"),
    "smtp_rcpt_to": _counted(f"turn % 4 = 3 AND role <> 'user' AND src = {H}", "b_mime"),
    "smtp_attachments_saved": _counted(f"turn % 4 = 3 AND src = {H}", "b_mime"),
}
_JSON = ", ".join(f"""'"{f.name}":' || CAST(to_json({f.name}) AS STRING)""" for f in FINDING.fields)


def _report_rows(section: str, key: str, value: str, source: str) -> str:
    return f"""SELECT {section} AS "Section", {key} AS "Key", {value} AS "Value" FROM {source}"""


@query("k01_long_report", _TRIAGE_SQL + " UNION ALL ".join([
    *[_report_rows("'Totals'", f"'{name}'", f"CAST({sql} AS STRING)", "(SELECT 1) one") for name, sql in _TOTALS.items()],
    f"SELECT * FROM ({_report_rows(chr(39) + 'TopDest' + chr(39), 'dst', 'CAST(CAST(sum(length) AS BIGINT) AS STRING)', f'lens WHERE src = {H} GROUP BY dst')}"
    " ORDER BY coalesce(sum(length), 0) DESC, dst LIMIT 50) t",
    _report_rows("'SuspiciousRequests'", "'count'", "CAST(count(*) AS STRING)", "found"),
    _report_rows("'SuspReq'", "CAST(frame_no AS STRING)",
                 f"'{{' || array_to_string(list_filter([{_JSON}], lambda x: x IS NOT NULL AND x NOT LIKE '%:null'), ',') || '}}'", "found"),
    _report_rows("'ParsedSavedFiles'", "'count'", "CAST(count(*) AS STRING)", "carried"),
    _report_rows("'ParsedFile'", "name", "'saved_as=' || saved || '; ' || CAST(octet_length(payload) AS STRING) || ' bytes; sha256=' "
                 f"|| sha256(payload) || '; type={C.TYPE_UNKNOWN}'", "carried")]))
def _(spark, sf):
    """The whole report over all kinds of packets."""
    return network.run(mixed_packets(spark, sf), HOST).report()


@query("w00_numbered", """
    SELECT src, frame_no, row_number() OVER (PARTITION BY src ORDER BY frame_no) AS row_no FROM b_http""")
def _(spark, sf):
    return numbered(bridge(spark, sf, "b_http").select("src", "frame_no"), ["src"], ["frame_no"], width=1000)
