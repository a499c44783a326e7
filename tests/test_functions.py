import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from egresslens.functions import binary as B, filetype, mime, text as X, times
from egresslens.operators import usb


@pytest.mark.parametrize("name,expected", [("", 0.0), ("aaaa", 0.0), ("ab", 1.0), (None, 0.0)])
def test_entropy(ev, name, expected):
    assert ev(X.entropy, name) == expected


@pytest.mark.parametrize("value,expected", [
    ("0xA:BC", b"\xab"), ("abc", b"\xab"), ("zz", None), (None, None), ("", None), ("de:ad be", b"\xde\xad\xbe")])
def test_decode_hex(ev, value, expected):
    got = ev(B.decode_hex, value)
    assert (bytes(got) if got is not None else None) == expected


@pytest.mark.parametrize("n,expected", [(0, "0.0B"), (1023, "1023.0B"), (1280, "1.2KB"), (1536, "1.5KB"), (5 * 1024**3, "5.0GB")])
def test_human_bytes(ev, n, expected):
    assert ev(X.human_bytes, n, kind="bigint") == expected


@pytest.mark.parametrize("value,expected", [
    ('multipart/x; Boundary="x y"', "x y"), ("boundary=--a", "--a"), ("text/plain", None), (None, None)])
def test_boundary(ev, value, expected):
    assert ev(mime.http_boundary, value) == expected


@pytest.mark.parametrize("value,expected", [
    ("filename*=UTF-8''a b.txt", "a b.txt"), ('attachment; FileName="a;b"', "a"), ("attachment", None)])
def test_disposition_filename(ev, value, expected):
    assert ev(mime.disposition_filename, value) == expected


@pytest.mark.parametrize("part,headers,body", [
    ("A: 1\r\na: 2\r\n\r\nx\r\n\r\n", {"a": "2"}, "x\r\n"),
    ("A: b: c\n\nx", {"a": "b: c"}, "x"),
    ("nothing here", {}, "nothing here"),
])
def test_part(ev, part, headers, body):
    assert ev(mime.part_headers, part) == headers
    assert ev(mime.part_body, part) == body


def test_binary_body_survives_extraction(ev):
    payload = bytes(range(256)) * 3
    raw = b'--b\r\nContent-Disposition: form-data; filename="x.bin"\r\n\r\n' + payload + b"\r\n--b--\r\n"
    files = ev(lambda c: mime.multipart_files(B.to_latin1(B.decode_hex(c)), F.lit("multipart/form-data; boundary=b")), raw.hex())
    assert [(f["filename"], bytes(f["data"])) for f in files] == [("x.bin", payload)]


@pytest.mark.parametrize("body,expected", [
    ("plain", "plain"), ("------q\r\nno file\r\n------q--", "------q\r\nno file\r\n------q--"),
    ("------q\r\nContent-Disposition: x; filename=\"f\"\r\n\r\nDATA\r\n------q--", "DATA")])
def test_peel(ev, body, expected):
    assert ev(mime.peel, body) == expected


def _mail(part_head, body):
    return f'Content-Type: multipart/mixed; boundary="m"\r\n\r\n--m\r\n{part_head}\r\n\r\n{body}\r\n--m--\r\n'


def test_mail_base64_needs_more_than_100_characters(ev):
    coded = lambda n: base64.b64encode(b"z" * n).decode()
    head = "Content-Transfer-Encoding: base64"
    short, long = coded(75), coded(78)
    assert (len(short), len(long)) == (100, 104)
    file = ev(mime.mail_attachments, _mail(head, short))[0]
    assert bytes(file["data"]) == short.encode()
    assert file["filename"] == f"smtp_attach_{hashlib.sha256(short.encode()).hexdigest()[:8]}.bin"
    assert bytes(ev(mime.mail_attachments, _mail(head, long))[0]["data"]) == b"z" * 78


def test_mail_damaged_base64_stays_raw(ev):
    damaged = "A" * 101
    file = ev(mime.mail_attachments, _mail('Content-Type: a; name="n.bin"', damaged))[0]
    assert (file["filename"], bytes(file["data"])) == ("n.bin", damaged.encode())


@pytest.mark.parametrize("message", [None, "", "Subject: x\r\n\r\nbody", _mail("X: y", "text")])
def test_mail_without_attachment(ev, message):
    assert ev(mime.mail_attachments, message) == []


@pytest.mark.parametrize("name,size,data,expected", [
    ("a", 0, None, "inode/x-empty"), ("a", 5, None, "application/octet-stream"), ("$MFT", 4, b"abcd", "filesystem/ntfs-meta"),
    ("a", 4, b"MZab", "application/x-dosexec"), ("a", 5, b"%PDF-", "application/pdf"), ("a", 4, b"abcd", "application/octet-stream"),
    ("a", 4, b"PK\x03\x04", "application/zip")])
def test_file_type(spark, name, size, data, expected):
    df = spark.createDataFrame([(name, size, data)], "n string, s bigint, d binary")
    assert df.select(filetype.detect_type(F.col("n"), F.col("s"), F.col("d"))).first()[0] == expected


@pytest.mark.parametrize("q,longest,sld,labels,sub", [("a1bcd.example.com", 7, "example", 3, 5), ("localhost", 9, "", 1, 0)])
def test_name_measures(ev, q, longest, sld, labels, sub):
    assert ev(X.longest_word_length, q) == longest
    assert ev(X.second_level_label, q) == sld
    assert ev(X.label_count, q) == labels
    assert ev(X.subdomain_length, q) == sub


@pytest.mark.parametrize("line,expected", [
    ("Jan  3 10:11:12 h usb 1-1: x", "1900-01-03T10:11:12"), ("Xyz 13 10:11:12 h", "Xyz 13 10:11:12"), ("none", None)])
def test_syslog_stamp(ev, line, expected):
    assert ev(times.syslog_stamp, line) == expected


def test_timestamp_text(ev):
    for text in ("2020-01-02 03:04:05", "2020-01-02 03:04:05.1", "2020-01-02 03:04:05.123456"):
        assert ev(times.parse_timestamp, text).isoformat(" ").rstrip("0") == text.rstrip("0")
    with pytest.raises(Exception):
        ev(times.parse_timestamp, "yesterday")


def test_usb_pairs(ev):
    pairs = ev(lambda c: F.struct(*[v.alias(k) for k, v in usb.usb_pairs(c).items()]),
               "usb 1-1: idVendor=0781, idProduct=5583 Product=Stick product=Last")
    assert (pairs["vendor"], pairs["product"], pairs["description"], pairs["serial"]) == ("0781,", "5583", "Last", None)
