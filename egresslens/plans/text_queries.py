"""Registered queries over scalar functions, DNS features and USB logs."""

from pyspark.sql import functions as F

from egresslens import constants as C
from egresslens.functions import binary as B, filetype, mime, text as X, times
from egresslens.operators import dns, filters, usb
from egresslens.plans.bridges import bridge, contents, mail_text, packets, table
from egresslens.plans.registry import query

Q = "rtrim(qname, '.')"
LABELS = f"list_filter(string_split({Q}, '.'), lambda x: x <> '')"


def _names(spark, sf):
    named = bridge(spark, sf, "b_dns").select("frame_no", "ts", X.dns_name(F.col("qname")).alias("q"))
    return named.dropna(subset=["q"])


def _per_name(spark, sf, **columns):
    return _names(spark, sf).select("frame_no", *[c.alias(n) for n, c in columns.items()])


_CHARS = f"length({Q}) - length(replace({Q}, c, ''))"


@query("x01_entropy", f"""
    SELECT frame_no, round(list_sum(list_transform(list_distinct(string_split({Q}, '')),
      lambda c: -(({_CHARS}) / length({Q})) * log2(({_CHARS}) / length({Q})))), 8) + 0.0 AS entropy FROM b_dns""")
def _(spark, sf):
    return _per_name(spark, sf, entropy=X.entropy(F.col("q"), 8))


@query("x02_decode_hex", """
    SELECT doc_id, sha256(encode(text)) AS sha256, md5(unhex(substr(hex(encode(text)), 1, 2 * (strlen(text) - 1)))) AS odd_md5,
           TRUE AS junk_is_null FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    digits = F.hex("text")
    colons = F.concat(F.lit("0x"), F.regexp_replace(digits, "(..)(?=.)", "$1:"))
    odd = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return docs.select("doc_id", B.sha256(B.decode_hex(colons)).alias("sha256"),
                       F.md5(B.decode_hex(odd)).alias("odd_md5"),
                       B.decode_hex(F.concat(F.lit("z"), digits)).isNull().alias("junk_is_null"))


@query("x03_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return contents(spark, sf).select("doc_id", B.content_sha256(F.col("content")).alias("sha256"))


@query("x04_md5", "SELECT doc_id, md5(text) AS md5 FROM documents")
def _(spark, sf):
    return contents(spark, sf).select("doc_id", B.content_md5(F.col("content")).alias("md5"))


_KINDS = {0: ("%PDF", "application/pdf"), 1: ("MZ", C.TYPE_EXECUTABLE), 2: ("", C.TYPE_UNKNOWN)}


@query("x05_file_type", f"""
    SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '{C.TYPE_NTFS_META}' ELSE CASE doc_id % 3
      WHEN 0 THEN 'application/pdf' WHEN 1 THEN '{C.TYPE_EXECUTABLE}' ELSE '{C.TYPE_UNKNOWN}' END END AS ftype FROM documents""")
def _(spark, sf):
    docs = contents(spark, sf)
    kind = F.col("doc_id") % 3
    head = F.when(kind == 0, "%PDF").when(kind == 1, "MZ").otherwise("")
    data = F.encode(F.concat(head, B.lossy_utf8(F.col("content"))), "UTF-8")
    name = F.when(F.col("doc_id") % 10 == 9, "$MFT").otherwise("a.bin")
    return docs.select("doc_id", filetype.detect_type(name, F.octet_length(data), data).alias("ftype"))


@query("x07_safe_filename", r"""
    SELECT page_id, regexp_replace(url, '[\\/:*?"<>|]', '', 'g') AS safe FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.safe_filename(F.col("url")).alias("safe"))


@query("x08_boundary", "SELECT frame_no, '----B' || CAST(conv_id AS STRING) AS boundary FROM b_mime")
def _(spark, sf):
    quoted = F.when(F.col("turn") % 2 == 0, F.regexp_replace("content_type", "boundary=(.*)", 'Boundary="$1" ')).otherwise(F.col("content_type"))
    return bridge(spark, sf, "b_mime").select("frame_no", mime.http_boundary(quoted).alias("boundary"))


def _latin(column):
    return B.utf8_to_latin1(F.col(column))


@query("x09_multipart_parts", """
    SELECT frame_no, CAST(2 AS INT) AS parts, CAST(strlen('Content-Disposition: form-data; name="f"; filename="' || role || '.txt"' || text) + 6 AS BIGINT) AS first_size FROM b_mime""")
def _(spark, sf):
    parts = mime.multipart_parts(_latin("body"), mime.http_boundary(F.col("content_type")))
    return bridge(spark, sf, "b_mime").select("frame_no", parts.alias("p")).select(
        "frame_no", F.size("p").alias("parts"), F.length(F.element_at("p", 1)).cast("bigint").alias("first_size"))


@query("x10_part_headers", """
    SELECT frame_no, 'content-disposition' AS keys, 'form-data; name="f"; filename="' || role || '.txt"' AS value,
           sha256(text) AS body_sha256 FROM b_mime""")
def _(spark, sf):
    parts = mime.multipart_parts(_latin("body"), mime.http_boundary(F.col("content_type")))
    one = bridge(spark, sf, "b_mime").select("frame_no", F.element_at(parts, 1).alias("part"))
    headers = mime.part_headers(F.col("part"))
    return one.select("frame_no", F.array_join(F.map_keys(headers), ",").alias("keys"),
                      headers["content-disposition"].alias("value"),
                      B.sha256(B.from_latin1(mime.part_body(F.col("part")))).alias("body_sha256"))


@query("x11_disposition_filename", "SELECT frame_no, role || '.txt' AS filename, TRUE AS absent_is_null FROM b_mime")
def _(spark, sf):
    header = F.concat(F.lit("attachment; FILENAME*=UTF-8''"), F.col("role"), F.lit(".txt; x=1"))
    return bridge(spark, sf, "b_mime").select(
        "frame_no", mime.disposition_filename(header).alias("filename"),
        mime.disposition_filename(F.col("content_type")).isNull().alias("absent_is_null"))


@query("x12_multipart_files", """
    SELECT frame_no, role || '.txt' AS filename, sha256(text) AS sha256 FROM b_mime""")
def _(spark, sf):
    files = mime.multipart_files(_latin("body"), F.col("content_type"))
    return bridge(spark, sf, "b_mime").select("frame_no", F.inline(files)).select(
        "frame_no", "filename", B.sha256(F.col("data")).alias("sha256"))


@query("x13_http_body", "SELECT frame_no, sha256(CASE WHEN turn % 2 = 0 THEN body ELSE text END) AS sha256 FROM b_mime")
def _(spark, sf):
    even = F.col("turn") % 2 == 0
    df = bridge(spark, sf, "b_mime").select(
        "frame_no", F.struct(F.when(even, F.hex("body")).otherwise("").alias("file_data"), F.lit("xyz").alias("payload")).alias("http"),
        F.struct(F.hex("text").alias("payload")).alias("tcp"), F.struct(F.lit("00").alias("data")).alias("data"))
    return df.select("frame_no", B.sha256(mime.http_body(F.col("http"), F.col("tcp"), F.col("data"))).alias("sha256"))


@query("x14_peel", r"""
    SELECT frame_no, sha256(regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g')) AS peeled, sha256(text) AS unchanged FROM b_mime""")
def _(spark, sf):
    peel = lambda c: B.sha256(B.from_latin1(mime.peel(_latin(c))))
    return bridge(spark, sf, "b_mime").select("frame_no", peel("body").alias("peeled"), peel("text").alias("unchanged"))


@query("x15_mail_attachments", r"""
    WITH m AS (SELECT frame_no, role, conv_id, CASE
        WHEN conv_id % 2 = 0 THEN encode(regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g'))
        WHEN length(b64) > 98 THEN encode(text) ELSE encode(CASE WHEN length(b64) > 76 THEN substr(b64, 1, 76) || chr(13) || chr(10) || substr(b64, 77) ELSE b64 END) END AS payload
        FROM (SELECT *, to_base64(encode(text)) AS b64 FROM b_mime) x)
    SELECT frame_no, CASE WHEN conv_id % 2 = 0 THEN role || '.eml' ELSE 'smtp_attach_' || substr(sha256(payload), 1, 8) || '.bin' END AS filename,
           sha256(payload) AS sha256 FROM m""")
def _(spark, sf):
    files = mime.mail_attachments(B.utf8_to_latin1(mail_text()))
    return bridge(spark, sf, "b_mime").select("frame_no", F.inline(files)).select(
        "frame_no", "filename", B.sha256(F.col("data")).alias("sha256"))


@query("x16_inline_mail_file", r"""
    SELECT frame_no, role || '.txt' AS filename, sha256('"' || chr(13) || chr(10) || chr(13) || chr(10)
      || regexp_replace(text, '[\r\n]+$', '', 'g')) AS sha256 FROM b_mime""")
def _(spark, sf):
    message = F.concat(F.lit("Subject: x\r\n\r\nfilename=\""), F.col("role"), F.lit('.txt""\r\n\r\n'), F.col("text"))
    files = mime.mail_attachments(B.utf8_to_latin1(message))
    return bridge(spark, sf, "b_mime").select("frame_no", F.inline(files)).select(
        "frame_no", "filename", B.sha256(F.col("data")).alias("sha256"))


@query("x17_headerless_mail_file", """
    SELECT frame_no, role || '.txt' AS filename,
           sha256('Content-Disposition: x; filename="' || role || '.txt"' || chr(10) || text) AS sha256 FROM b_mime""")
def _(spark, sf):
    message = F.concat(F.lit('Content-Disposition: x; filename="'), F.col("role"), F.lit('.txt"\n'), F.col("text"))
    files = mime.mail_attachments(B.utf8_to_latin1(message))
    return bridge(spark, sf, "b_mime").select("frame_no", F.inline(files)).select(
        "frame_no", "filename", B.sha256(F.col("data")).alias("sha256"))


@query("x20_dns_name", f"SELECT frame_no, {Q} AS q FROM b_dns")
def _(spark, sf):
    return _per_name(spark, sf, q=F.col("q"))


@query("x21_labels", f"""
    SELECT frame_no, CAST(len({LABELS}) AS BIGINT) AS labels,
           CAST(list_max(list_transform({LABELS}, lambda x: length(x))) AS BIGINT) AS labels_max,
           round(list_sum(list_transform({LABELS}, lambda x: length(x))) / len({LABELS}), 10) AS labels_average FROM b_dns""")
def _(spark, sf):
    q = F.col("q")
    return _per_name(spark, sf, labels=X.label_count(q), labels_max=X.label_max(q), labels_average=X.label_average(q))


@query("x22_subdomain", f"""
    SELECT frame_no, CAST(len({LABELS}) > 2 AS INT) AS subdomain,
           CAST(length(array_to_string({LABELS}[1:-3], '.')) AS BIGINT) AS subdomain_length FROM b_dns""")
def _(spark, sf):
    return _per_name(spark, sf, subdomain=X.has_subdomain(F.col("q")), subdomain_length=X.subdomain_length(F.col("q")))


@query("x23_character_classes", f"""
    SELECT frame_no, CAST(length(regexp_replace({Q}, '[^\\p{{Lu}}]', '', 'g')) AS BIGINT) AS upper,
           CAST(length(regexp_replace({Q}, '[^\\p{{Ll}}]', '', 'g')) AS BIGINT) AS lower,
           CAST(length(regexp_replace({Q}, '[^0-9]', '', 'g')) AS BIGINT) AS numeric,
           CAST(length(regexp_replace({Q}, '[^_-]', '', 'g')) AS BIGINT) AS special FROM b_dns""")
def _(spark, sf):
    q = F.col("q")
    return _per_name(spark, sf, upper=X.count_class(q, X.UPPER), lower=X.count_class(q, X.LOWER),
                     numeric=X.count_class(q, X.DIGIT), special=X.count_class(q, X.SPECIAL))


_WORD = "list_max(list_transform(regexp_split_to_array({}, '[^\\p{{L}}]+'), lambda x: length(x)))".format(Q)


@query("x24_longest_word", f"SELECT frame_no, CAST({_WORD} AS BIGINT) AS longest_word FROM b_dns")
def _(spark, sf):
    return _per_name(spark, sf, longest_word=X.longest_word_length(F.col("q")))


@query("x25_second_level_label", f"SELECT frame_no, coalesce({LABELS}[-2], '') AS sld FROM b_dns")
def _(spark, sf):
    return _per_name(spark, sf, sld=X.second_level_label(F.col("q")))


@query("x26_name_length", f"SELECT frame_no, CAST(length({Q}) AS BIGINT) AS len FROM b_dns")
def _(spark, sf):
    return _per_name(spark, sf, len=F.length("q").cast("bigint"))


@query("x27_millis_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS text FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", times.millis_text(F.col("ts")).alias("text"))


@query("x28_parse_timestamp", "SELECT event_id, date_trunc('second', ts) AS whole, date_trunc('millisecond', ts) AS parsed FROM events")
def _(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", times.parse_timestamp(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("whole"),
        times.parse_timestamp(times.millis_text(ts)).cast("timestamp_ntz").alias("parsed"))


_ANGLES = {"hour": ("extract(hour FROM ts)", 24), "minute": ("extract(minute FROM ts)", 60), "second": ("floor(extract(second FROM ts))", 60),
           "ms": ("extract(microsecond FROM ts) % 1000000", 1000000), "dow": ("isodow(ts) - 1", 7), "month": ("extract(month FROM ts) - 1", 12)}
_CYCLIC = ", ".join(f"round({f}(2 * pi() * ({e}) / {p}), 8) + 0.0 AS {n}_{f}" for n, (e, p) in _ANGLES.items() for f in ("sin", "cos"))


@query("x29_cyclic_encoding", f"SELECT event_id, {_CYCLIC} FROM events")
def _(spark, sf):
    out = times.encode_cyclic(table(spark, sf, "events").select("event_id", F.col("ts").alias("timestamp")))
    return out.select("event_id", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in out.columns if c != "event_id"])


_STAMP = """CASE WHEN line LIKE 'Jan  3%' THEN '1900-01-03T10:11:12'
    ELSE '1900-01-13T10:11:1' || substr(line, 15, 1) END"""


@query("x30_syslog_stamp", f"SELECT line_no, {_STAMP} AS stamp FROM b_usb")
def _(spark, sf):
    return bridge(spark, sf, "b_usb").select("line_no", times.syslog_stamp(F.col("line")).alias("stamp"))


_PAIR = lambda key: f"nullif(regexp_extract(line, '{key}=(\\S+)', 1), '')"


@query("x31_usb_pairs", f"""
    SELECT line_no, {_PAIR('idVendor')} AS vendor, {_PAIR('idProduct')} AS product, {_PAIR('Manufacturer')} AS manufacturer,
           CAST(NULL AS STRING) AS description, {_PAIR('SerialNumber')} AS serial FROM b_usb""")
def _(spark, sf):
    return bridge(spark, sf, "b_usb").select("line_no", *[c.alias(n) for n, c in usb.usb_pairs(F.col("line")).items()])


@query("x34_registered_domain", f"SELECT frame_no, array_to_string(string_split({Q}, '.')[-2:], '.') AS domain FROM b_dns")
def _(spark, sf):
    return _per_name(spark, sf, domain=X.registered_domain(F.col("q")))


@query("x35_set_as_json", "SELECT source, CAST(to_json(list_sort(list(DISTINCT lang))) AS STRING) AS langs FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(X.as_json(F.collect_set("lang")).alias("langs"))


@query("x36_smtp_body", "SELECT frame_no, sha256(text) AS sha256, sha256('plain ' || text) AS plain FROM b_mime")
def _(spark, sf):
    df = bridge(spark, sf, "b_mime")
    none = F.struct(F.lit(None).cast("string").alias("payload"))
    data = F.struct(F.lit(None).cast("string").alias("data"))
    smtp = lambda c: F.struct(c.alias("data"), F.lit("00").alias("line"), F.lit(None).cast("string").alias("payload"))
    return df.select("frame_no", B.sha256(mime.smtp_body(smtp(F.hex("text")), none, data)).alias("sha256"),
                     B.sha256(mime.smtp_body(smtp(F.concat(F.lit("plain "), F.col("text"))), none, data)).alias("plain"))


@query("x37_cast_categories", "SELECT doc_id, CAST(quality AS STRING) AS quality, CAST(toxic AS STRING) AS toxic FROM labels")
def _(spark, sf):
    from egresslens.operators.encode import cast_categories
    return cast_categories(table(spark, sf, "labels"), ["quality", "toxic", "absent"])


# --- DNS features ------------------------------------------------------------------------------

@query("n01_lexical_features", f"""
    SELECT frame_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS "timestamp", CAST(length({Q}) AS BIGINT) AS "FQDN_count",
      CAST(length(array_to_string({LABELS}[1:-3], '.')) AS BIGINT) AS subdomain_length,
      CAST(length(regexp_replace({Q}, '[^\\p{{Lu}}]', '', 'g')) AS BIGINT) AS upper,
      CAST(length(regexp_replace({Q}, '[^\\p{{Ll}}]', '', 'g')) AS BIGINT) AS lower,
      CAST(length(regexp_replace({Q}, '[^0-9]', '', 'g')) AS BIGINT) AS numeric,
      round(list_sum(list_transform(list_distinct(string_split({Q}, '')),
        lambda c: -(({_CHARS}) / length({Q})) * log2(({_CHARS}) / length({Q})))), 8) + 0.0 AS entropy,
      CAST(length(regexp_replace({Q}, '[^_-]', '', 'g')) AS BIGINT) AS special, CAST(len({LABELS}) AS BIGINT) AS labels,
      CAST(list_max(list_transform({LABELS}, lambda x: length(x))) AS BIGINT) AS labels_max,
      round(list_sum(list_transform({LABELS}, lambda x: length(x))) / len({LABELS}), 10) AS labels_average,
      CAST({_WORD} AS BIGINT) AS longest_word, coalesce({LABELS}[-2], '') AS sld, CAST(length({Q}) AS BIGINT) AS len,
      CAST(len({LABELS}) > 2 AS INT) AS subdomain FROM b_dns""")
def lexical(spark, sf):
    return dns.lexical_features(packets(spark, sf, "b_dns")).withColumn("entropy", F.round("entropy", 8))


_TYPE_NAMES = {1: "A", 28: "AAAA", 2: "NS", 16: "TXT", 99: "OTHER"}
_FREQ = ", ".join(f"CAST(count(*) FILTER (WHERE rr_type = {t}) AS BIGINT) AS \"{n}_frequency\"" for t, n in C.RR_TYPES.items())


@query("a06_record_types", f"SELECT frame_no, {_FREQ} FROM b_rr GROUP BY frame_no")
def _(spark, sf):
    counts = dns.record_type_counts(F.col("dns.rr"))
    return packets(spark, sf, "b_rr").select("frame_no", *[c.alias(n) for n, c in counts.items()])


_MOMENTS = """SELECT frame_no, CAST(count(*) AS BIGINT) AS rr_count, round(avg(ttl), 8) AS ttl_mean,
    round(coalesce(var_samp(ttl), 0), 6) AS ttl_variance, CAST(to_json(list_sort(list(DISTINCT ttl))) AS STRING) AS unique_ttl,
    CAST(count(DISTINCT CASE WHEN rr_type IN (1, 28) THEN rdata END) AS BIGINT) AS distinct_ip,
    round(coalesce(count(*) FILTER (WHERE rr_type = 1) / nullif(count(*) FILTER (WHERE rr_type IN (1, 28)), 0), 0), 8) AS rr
    FROM b_rr GROUP BY frame_no"""


@query("a07_response_moments", _MOMENTS)
def _(spark, sf):
    f = dns.response_features(packets(spark, sf, "b_rr"))
    return f.select("frame_no", "rr_count", F.round("ttl_mean", 8).alias("ttl_mean"),
                    F.round("ttl_variance", 6).alias("ttl_variance"), "unique_ttl", "distinct_ip", F.round("rr", 8).alias("rr"))


_DOMAINS = """ip_d AS (SELECT DISTINCT rdata AS ip, array_to_string(string_split(qname, '.')[-2:], '.') AS domain
    FROM b_rr WHERE rr_type IN (1, 28))"""


@query("j06_ip_domains", f"WITH {_DOMAINS} SELECT ip, domain FROM ip_d")
def _(spark, sf):
    return dns.ip_domains(packets(spark, sf, "b_rr"))


@query("j06_shared_domains", f"""
    WITH {_DOMAINS}, hit AS (SELECT DISTINCT frame_no, rdata AS ip FROM b_rr WHERE rr_type IN (1, 28))
    SELECT frame_no, CAST(to_json(list_sort(list(DISTINCT domain))) AS STRING) AS domains FROM hit JOIN ip_d USING (ip) GROUP BY frame_no""")
def _(spark, sf):
    f = dns.response_features(packets(spark, sf, "b_rr"))
    return f.filter(F.col("distinct_ip") > 0).select("frame_no", F.col("distinct_domains").alias("domains"))


@query("j09_geo_lookup", """
    SELECT s_suppkey AS address, g.iso, g.asn FROM supplier JOIN b_geo g ON s_suppkey BETWEEN g.lo AND g.hi""")
def _(spark, sf):
    addresses = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("address")).distinct()
    return dns.geo_lookup(addresses, bridge(spark, sf, "b_geo"))


_NESTED_RANGES = """SELECT lo, hi, iso, asn FROM b_geo
    UNION ALL SELECT CAST(r_regionkey * 20 AS BIGINT), CAST(r_regionkey * 20 + 45 AS BIGINT), substr(r_name, 1, 2), 'wide' FROM region
    UNION ALL SELECT CAST(n_nationkey * 4 + 1 AS BIGINT), CAST(n_nationkey * 4 + 2 AS BIGINT), 'in', CAST(n_nationkey AS STRING) FROM nation WHERE n_nationkey % 3 = 0
    UNION ALL SELECT CAST(0 AS BIGINT), CAST(1000000 AS BIGINT), 'all', 'all' FROM region WHERE r_regionkey = 0"""


@query("j09_nested_ranges", f"""
    WITH r AS ({_NESTED_RANGES})
    SELECT c_custkey AS address, iso, asn FROM customer JOIN r ON c_custkey BETWEEN lo AND hi
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY hi - lo, lo, iso, asn) = 1""")
def _(spark, sf):
    """The narrowest of nested and overlapping ranges around every customer key."""
    for name in ("region", "nation"):
        table(spark, sf, name).createOrReplaceTempView(name)
    bridge(spark, sf, "b_geo").createOrReplaceTempView("b_geo")
    return dns.geo_lookup(table(spark, sf, "customer").select(F.col("c_custkey").alias("address")), spark.sql(_NESTED_RANGES))


_ADDRESS_6 = """'2001:db8:' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN ':0:0:0:0:' ELSE '::' END || CAST(c_custkey % 10000 AS VARCHAR)"""


@query("j09_geo_lookup_v6", f"""
    SELECT DISTINCT {_ADDRESS_6} AS ip, substr(n_name, 1, 2) AS iso, 'AS' || CAST(n_regionkey AS VARCHAR) AS asn
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 = 0""")
def _(spark, sf):
    ip = F.concat(F.lit("2001:db8:"), F.col("c_nationkey").cast("string"),
                  F.when(F.col("c_custkey") % 3 == 0, ":0:0:0:0:").otherwise("::"), (F.col("c_custkey") % 10000).cast("string"))
    addresses = table(spark, sf, "customer").select(ip.alias("ip")).distinct().withColumn("address", dns.ipv6_digits(F.col("ip")))
    key = F.col("n_nationkey").cast("string")
    ranges = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(
        F.concat(F.lit("2001:DB8:"), key, F.lit("::")).alias("lo"), F.concat(F.lit("2001:db8:"), key, F.lit(":ffff:ffff:ffff:ffff:ffff")).alias("hi"),
        F.substring("n_name", 1, 2).alias("iso"), F.concat(F.lit("AS"), F.col("n_regionkey").cast("string")).alias("asn"))
    return dns.geo_lookup_v6(addresses, ranges).select("ip", "iso", "asn")


def _ranges(spark, sf):
    # One range per nation over the second octet of the record addresses.
    base = 198 * 16777216 + 51 * 65536
    geo = bridge(spark, sf, "b_geo")
    return geo.select((F.lit(base) + F.col("lo") * 512).alias("lo"), (F.lit(base) + F.col("hi") * 512 + 511).alias("hi"), "iso", "asn")


_RR_ENTROPY = "list_sum(list_transform(list_distinct(string_split(rr_name, '')), lambda c: -((length(rr_name) - length(replace(rr_name, c, ''))) / length(rr_name)) * log2((length(rr_name) - length(replace(rr_name, c, ''))) / length(rr_name))))"


@query("n02_response_features", f"""
    WITH {_DOMAINS}, hit AS (SELECT DISTINCT frame_no, rdata AS ip FROM b_rr WHERE rr_type IN (1, 28)),
    num AS (SELECT DISTINCT frame_no, ip, CAST(198 AS BIGINT) * 16777216 + 51 * 65536 + CAST(string_split(ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip, '.')[4] AS BIGINT) AS n FROM hit),
    geo AS (SELECT frame_no, list_sort(list(DISTINCT iso)) AS c, list_sort(list(DISTINCT asn)) AS a FROM num
            JOIN b_geo g ON n BETWEEN CAST(198 AS BIGINT) * 16777216 + 51 * 65536 + lo * 512 AND CAST(198 AS BIGINT) * 16777216 + 51 * 65536 + hi * 512 + 511 GROUP BY frame_no),
    dom AS (SELECT frame_no, list_sort(list(DISTINCT domain)) AS d FROM hit JOIN ip_d USING (ip) GROUP BY frame_no),
    base AS ({_MOMENTS}), freq AS (SELECT frame_no, {_FREQ},
      CAST(to_json(list_sort(list(DISTINCT CASE rr_type WHEN 1 THEN 'A' WHEN 28 THEN 'AAAA' WHEN 2 THEN 'NS' WHEN 16 THEN 'TXT' ELSE 'OTHER' END))) AS STRING) AS rr_type,
      round(avg({_RR_ENTROPY}), 6) AS rr_name_entropy, round(avg(length(rr_name)), 8) AS rr_name_length FROM b_rr GROUP BY frame_no)
    SELECT base.*, freq.* EXCLUDE (frame_no), "NS_frequency" AS distinct_ns, "A_frequency" AS a_records, 'unknown' AS reverse_dns,
      CAST(to_json(coalesce(c, [])) AS STRING) AS unique_country, CAST(to_json(coalesce(a, [])) AS STRING) AS unique_asn,
      CAST(to_json(coalesce(d, [])) AS STRING) AS distinct_domains
    FROM base JOIN freq USING (frame_no) LEFT JOIN geo USING (frame_no) LEFT JOIN dom USING (frame_no)""")
def response(spark, sf):
    f = dns.response_features(packets(spark, sf, "b_rr"), _ranges(spark, sf))
    rounded = {"rr_name_entropy": 6, "rr_name_length": 8, "ttl_mean": 8, "ttl_variance": 6, "rr": 8}
    return f.withColumns({c: F.round(c, n) for c, n in rounded.items()})


# --- USB ---------------------------------------------------------------------------------------

@query("f12_usb_lines", "SELECT file, line_no FROM b_usb WHERE line LIKE '%kernel: usb%'")
def _(spark, sf):
    return filters.usb_lines(bridge(spark, sf, "b_usb")).select("file", "line_no")


@query("w03_usb_history", f"""
    WITH u AS (SELECT file, line_no, {_STAMP} AS stamp, {_PAIR('idVendor')} AS vendor, {_PAIR('idProduct')} AS product,
        {_PAIR('Manufacturer')} AS manufacturer, {_PAIR('SerialNumber')} AS serial FROM b_usb WHERE line LIKE '%kernel: usb%'),
    g AS (SELECT *, sum(CASE WHEN vendor IS NOT NULL OR product IS NOT NULL THEN 1 ELSE 0 END)
          OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g0 FROM u),
    r AS (SELECT file, coalesce(g0, 0) AS grp, max(line_no) AS line_no, arg_max(stamp, line_no) AS "timestamp",
        arg_max(vendor, line_no) FILTER (WHERE vendor IS NOT NULL) AS vendor, arg_max(product, line_no) FILTER (WHERE product IS NOT NULL) AS product,
        arg_max(manufacturer, line_no) FILTER (WHERE manufacturer IS NOT NULL) AS manufacturer, CAST(NULL AS STRING) AS description,
        arg_max(serial, line_no) FILTER (WHERE serial IS NOT NULL) AS serial, bool_or(vendor IS NOT NULL) AS done FROM g GROUP BY 1, 2)
    SELECT file, line_no, "timestamp", vendor, product, manufacturer, description, serial FROM r WHERE done""")
def usb_history(spark, sf):
    return usb.linux_usb_events(bridge(spark, sf, "b_usb"))
