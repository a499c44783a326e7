import random

import pytest
from pyspark.sql import functions as F

from egresslens.operators import detect, dns, filters, match, models, objects, stats, usb
from egresslens.operators.ordered import running
from egresslens.operators.skew import spread_hot_keys
from egresslens.plans import disk, training
from egresslens.schemas import PACKETS, conform, layer
from egresslens.session import materialize

HOST = "10.0.0.1"


def packet(spark, src=HOST, dst="9.9.9.9", **layers):
    base = spark.range(1).select(F.lit(1).alias("frame_no"), F.lit(src).alias("src"), F.lit(dst).alias("dst"))
    built = {name: layer(name, **{k: F.lit(v) for k, v in fields.items()}) for name, fields in layers.items()}
    return conform(base, PACKETS, ip=layer("ip", src=F.col("src"), dst=F.col("dst")), **built)


def hits(df, *detectors):
    return detect.findings(df, *detectors).collect()


@pytest.mark.parametrize("length,n", [("5242880", 1), ("5242879", 0), ("abc", 0)])
def test_large_http(spark, length, n):
    p = packet(spark, http=dict(request_method="post", content_length=length))
    assert len(hits(p, detect.large_http(HOST))) == n


def test_large_smtp_is_strict(spark):
    for size, n in ((100, 0), (101, 1)):
        p = packet(spark, smtp=dict(data="zz" + "y" * (size - 2)))
        assert len(hits(p, detect.large_smtp(HOST, 100))) == n


@pytest.mark.parametrize("name,n", [("a" * 50 + "..", 0), ("a" * 51 + ".", 1)])
def test_long_name(spark, name, n):
    assert len(hits(packet(spark, dns=dict(qr="0", qname=name)), detect.long_dns_name())) == n


@pytest.mark.parametrize("src,cmd,note", [
    (HOST, "stor", "FTP file upload (STOR) from host"), ("8.8.8.8", "STOR", "FTP transfer filename observed"),
    (HOST, "RETR", "FTP transfer filename observed")])
def test_ftp(spark, src, cmd, note):
    p = packet(spark, src=src, ftp=dict(request_command=cmd, request_arg="f"))
    assert [r["note"] for r in hits(p, detect.ftp_upload(HOST), detect.ftp_filename(HOST))] == [note]


def test_smb(spark):
    for src, cmd, n in ((HOST, "5", 1), (HOST, "9", 1), ("8.8.8.8", "5", 0), (HOST, "8", 0)):
        assert len(hits(packet(spark, src=src, smb2=dict(cmd=cmd, filename="f")), detect.smb_write(HOST))) == n
    both = packet(spark, smb=dict(cmd="0x00"), smb2=dict(cmd="5"))
    assert hits(both, detect.smb_write(HOST)) == []


def test_tftp_name_falls_back(spark):
    p = packet(spark, tftp=dict(opcode="2", filename=" ", text="Opcode, File: x.bin, y"))
    assert hits(p, detect.tftp_write(HOST))[0]["filename"] == "x.bin"


def test_smb_read_filter(spark):
    kept = packet(spark).unionByName(packet(spark, smb2=dict(cmd="8"))).unionByName(packet(spark, smb2=dict(cmd="9")))
    assert filters.drop_smb_reads(kept).count() == 2


def test_host_layer():
    assert [filters.host_layer(h) for h in ("1.2.3.4", "::1", "aa:bb:cc:dd:ee:ff")] == ["ip", "ipv6", "eth"]


def test_unique_names(spark):
    names = ["a.txt", "a.txt", "a/b.txt", "a.txt", ".hid", ".hid"]
    df = spark.createDataFrame([(i, 0, "HTTP", n) for i, n in enumerate(names)],
                               "frame_no bigint, part_no int, proto string, original_filename string")
    got = [r["filename"] for r in objects.unique_names(df, width=2).orderBy("frame_no").collect()]
    assert got == ["a.txt", "a(1).txt", "ab.txt", "a(2).txt", ".hid", ".hid(1)"]


def test_running_equals_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    for inclusive in (True, False):
        got = running(df, ["k"], ["i"], sums={"s": F.lit(1).cast("bigint")}, lasts={"l": F.col("v")}, width=37, inclusive=inclusive)
        seen, last, want = {}, {}, set()
        for k, i, v in rows:
            if not inclusive:
                want.add((k, i, seen.get(k, 0), last.get(k)))
            seen[k] = seen.get(k, 0) + 1
            last[k] = v if v is not None else last.get(k)
            if inclusive:
                want.add((k, i, seen[k], last[k]))
        assert {(r["k"], r["i"], r["s"], r["l"]) for r in got.collect()} == want


def test_usb_carry_over(spark):
    lines = ["Jan  1 00:00:01 usb 1-1: SerialNumber=S1", "Jan  1 00:00:02 usb 1-1: idVendor=1 idProduct=2",
             "Jan  1 00:00:03 usb 1-1: SerialNumber=S2", "noise idVendor=9", "Jan  1 00:00:04 usb 1-1: idVendor=3"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no bigint, line string")
    got = [(r["vendor"], r["serial"]) for r in usb.linux_usb_events(df, width=2).orderBy("line_no").collect()]
    assert got == [("1", "S1"), ("3", "S2")]


def test_match_once_per_path(spark):
    files = spark.createDataFrame([("/a", "s", "m", 0), ("/b", "x", "m", 0), ("/c", "x", "y", 0), ("/a", "s", "m", 9)],
                                  "path string, sha256 string, md5 string, partition_offset bigint")
    targets = spark.createDataFrame([("t", "s", "m"), ("u", "s", "m"), ("v", None, None)], "path string, sha256 string, md5 string")
    got = {(r["path"], r["match_type"], r["partition_offset"]) for r in disk.match_files(files, targets).collect()}
    assert got == {("/a", "sha256", 0), ("/b", "md5", 0)}
    assert match.hash_match(files, targets, "sha256").count() == 2
    with pytest.raises(KeyError):
        match.exact_matches(files.drop("md5"), targets)


def test_no_type_list_keeps_all(spark):
    files = spark.createDataFrame([("/a", "text/x"), ("/b", None)], "path string, ftype string")
    none = spark.createDataFrame([(None,)], "ftype string")
    some = spark.createDataFrame([("text",)], "ftype string")
    assert filters.type_prefix_filter(files, none).count() == 2
    assert [r["path"] for r in filters.type_prefix_filter(files, some).collect()] == ["/a"]


def test_verdict(spark):
    rows = [(1, 0.55, None, True), (2, 0.45, None, False), (3, 0.45, 0.9, True), (4, 0.55, 0.1, False), (5, 0.9, 0.1, True)]
    df = spark.createDataFrame(rows, "frame_no int, p1 double, p2 double, hit boolean")
    judged = models.verdicts(df, 0.5, 0.5).collect()
    assert all((r["classification"] == "exfiltration") == r["hit"] for r in judged)


def test_auc_with_few_and_many_stretches(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.choice([0.0, 0.1, 0.1001, 0.9])) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    for stretches in (2, 50):
        assert stats.roc_auc(stats.roc_counts(df, stretches=stretches)).first()["auc"] == pytest.approx(want)


def test_hot_keys_on_either_side_meet_once(spark):
    left = spark.createDataFrame([(i % 2, i) for i in range(60)], "k int, a int")
    right = spark.createDataFrame([(0, i) for i in range(90)] + [(1, 1)], "k int, b int")
    x, y = spread_hot_keys(left, right, ["k"], 20)
    met = x.join(y, ["k", "salt"])
    assert met.count() == met.select("a", "b").distinct().count() == 30 * 90 + 30
    assert max(r["count"] for r in x.groupBy("k", "salt").count().collect()) < 30
    assert max(r["count"] for r in y.groupBy("k", "salt").count().collect()) < 45


def test_packets_are_told_apart_by_capture(spark):
    kinds = "capture_id string, frame_no bigint"
    first = spark.createDataFrame([("x", 1, 0.1), ("y", 1, 0.2), (None, 1, 0.3)], kinds + ", p1 double")
    second = spark.createDataFrame([("x", 1, 0.4), (None, 1, 0.5)], kinds + ", p2 double")
    got = {r["capture_id"]: (r["p1"], r["p2"]) for r in models.pair_scores(first, second).collect()}
    assert got == {"x": (0.1, 0.4), "y": (0.2, None), None: (0.3, 0.5)}


def test_ipv6_digits_equal_the_standard_library(spark):
    import ipaddress
    good = ["::", "::1", "1::", "2001:db8::ff00:42:8329", "2001:DB8:0:0:1:0:0:1", "fe80::1:2:3:4:5:6", "::ffff:192.0.2.1",
            "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4"]
    bad = ["", ":", ":::", "1::2::3", "1:2:3", "12345::", "g::1", "1:2:3:4:5:6:7:8:9", "10.0.0.1", "1:2:3:4:5:6:7:", ":1:2:3:4:5:6:7", None]
    df = spark.createDataFrame([(ip,) for ip in good + bad], "ip string")
    got = {r["ip"]: r["d"] for r in df.select("ip", dns.ipv6_digits(F.col("ip")).alias("d")).collect()}
    assert {ip: got[ip] for ip in good} == {ip: f"{int(ipaddress.IPv6Address(ip)):032x}" for ip in good}
    assert [ip for ip in bad if got[ip] is not None] == []


def test_ipv6_ranges_of_any_width(spark):
    ranges = spark.createDataFrame([("2001:db8::", "2001:db8::ff", "A", "x"), ("::", "ffff::", "B", "y"),
                                    ("2001:db8::fe", "2001:db8::1:0", "C", "z"), ("nothing", "::1", "D", "w")],
                                   "lo string, hi string, iso string, asn string")
    addresses = spark.createDataFrame([("2001:db8::fe",), ("2001:db8::100",), ("ffff::1",)], "ip string").withColumn(
        "address", dns.ipv6_digits(F.col("ip")))
    got = sorted((r["ip"], r["iso"]) for r in dns.geo_lookup_v6(addresses, ranges).collect())
    assert got == [("2001:db8::100", "B"), ("2001:db8::100", "C"), ("2001:db8::fe", "A"), ("2001:db8::fe", "B"), ("2001:db8::fe", "C")]


def test_address_sets_meet_all_domains_of_their_addresses(spark):
    rows = [("a.one.com", ["1.1.1.1", "2.2.2.2"]), ("b.two.com", ["1.1.1.1"]), ("c.three.com", ["2.2.2.2"]), ("d.four.com", ["3.3.3.3"])]
    df = spark.createDataFrame(rows, "q string, ips array<string>").select(F.struct(
        F.col("q").alias("qname"), F.transform("ips", lambda i: F.struct(F.lit(1).alias("type"), i.alias("rdata"))).alias("rr")).alias("dns"))
    got = {tuple(r["ips"]): r["domains"] for r in dns.shared_domains(df).collect()}
    assert got == {("1.1.1.1", "2.2.2.2"): ["one.com", "three.com", "two.com"], ("1.1.1.1",): ["one.com", "two.com"],
                   ("2.2.2.2",): ["one.com", "three.com"], ("3.3.3.3",): ["four.com"]}


def test_synthetic_rows_have_keys_of_their_own(spark):
    part = spark.createDataFrame([(i, 1 if i % 2 else 0, float(i)) for i in range(1, 21)], "frame_no bigint, class int, x double")
    keys = [r["frame_no"] for r in training.augmented(part, ["x"], 40, "frame_no").collect()]
    assert len(keys) == len(set(keys)) == 60


def test_response_features_read_the_packets_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        read.add(1)
        return name

    rows = [(i, f"a.d{i % 3}.com", [f"10.0.0.{j}" for j in range(i % 4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "frame_no bigint, q string, ips array<string>").repartition(3).select("frame_no", F.struct(
        seen("q").alias("qname"), F.transform("ips", lambda i: F.struct(F.lit(1).alias("type"), i.alias("rdata"), F.lit(5).cast("bigint").alias("ttl"),
                                                                        F.col("q").alias("name"))).alias("rr")).alias("dns"))
    ranges = spark.createDataFrame([(167772160, 167772161, "A", "x")], "lo bigint, hi bigint, iso string, asn string")
    got = {r["frame_no"]: (r["distinct_domains"], r["unique_country"], r["distinct_ip"]) for r in dns.response_features(df, ranges).collect()}
    domains = '["d0.com","d1.com","d2.com"]'
    assert got == {i: (domains, '["A"]', i % 4) for i in range(40) if i % 4}
    assert read.value == 30


def test_address_sets_are_not_broadcast(spark):
    """Their files say little of their size in memory."""
    rows = spark.range(1000).select(F.col("id").alias("frame_no"), F.struct(F.lit("a.b.com").alias("qname"), F.array(F.struct(
        F.lit(1).alias("type"), F.concat(F.lit("10.0.0."), (F.col("id") % 9).cast("string")).alias("rdata"))).alias("rr")).alias("dns"))
    packets = materialize(rows, "few-bytes")
    ranges = spark.createDataFrame([(167772160, 167772161, "A", "x")], "lo bigint, hi bigint, iso string, asn string")
    for made in (dns.shared_domains(packets), dns.geo_sets(packets, ranges)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        held = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "[ip#" in line]
        assert held == []
