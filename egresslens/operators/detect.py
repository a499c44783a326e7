"""Detectors: a condition on a packet and the finding it gives.

``findings`` evaluates any number of them in one pass over the packets, so adding a detector
never adds a scan; packets no condition holds for are dropped before any finding is built. They
hold no state and work the same on batch and stream.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from egresslens import constants as C
from egresslens.functions.binary import let, to_latin1
from egresslens.functions.mime import disposition_filename, mail_attachments, smtp_body
from egresslens.functions.text import blank_to_null, dns_name, human_bytes, strip
from egresslens.operators.filters import destination, is_dns_query, source
from egresslens.schemas import FINDING


def finding(**values) -> Column:
    """A finding struct; the fields not given are NULL."""
    return F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING.fields
    ])


@dataclass
class Detector:
    condition: Column
    finding: Column


def _hit(condition: Column, proto, note, **values) -> Detector:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    base = dict(proto=as_col(proto), note=as_col(note), src=source(), dst=destination(),
                capture_id=F.col("capture_id"), frame_no=F.col("frame_no"))
    base.update({name: as_col(v) for name, v in values.items()})
    return Detector(condition, finding(**base))


def _int(expression: str) -> Column:
    return F.expr(f"try_cast({expression} AS bigint)")


def large_http(host: str, threshold: int = C.LARGE_UPLOAD_BYTES) -> Detector:
    size = _int("trim(http.content_length)")
    method = F.upper(F.col("http.request_method"))
    return _hit(method.isNotNull() & (source() == host) & (size >= threshold),
                "HTTP", C.NOTE_HTTP_LARGE, method=method, content_length=size)


def disposition_seen() -> Detector:
    """A file name in a disposition header, recorded whether or not a body was saved."""
    name = disposition_filename(F.col("http.content_disposition"))
    return _hit(name.isNotNull(), "HTTP", C.NOTE_HTTP_DISPOSITION, filename=name)


def _ftp_command() -> Column:
    return F.upper(F.col("ftp.request_command"))


def ftp_upload(host: str) -> Detector:
    return _hit((_ftp_command() == "STOR") & (source() == host), "FTP", C.NOTE_FTP_STOR,
                command="STOR", filename=F.col("ftp.request_arg"))


def ftp_filename(host: str) -> Detector:
    from_host = F.coalesce(source() == host, F.lit(False))
    seen = (_ftp_command() == "RETR") | ((_ftp_command() == "STOR") & ~from_host)
    return _hit(seen, "FTP", C.NOTE_FTP_SEEN, command=_ftp_command(),
                filename=F.col("ftp.request_arg"))


def tftp_filename() -> Column:
    rendered = F.regexp_extract(F.col("tftp.text"), C.RE_TFTP_FILE, 1)
    return F.coalesce(
        blank_to_null(strip(F.col("tftp.filename"))),
        blank_to_null(strip(F.col("tftp.destination_file"))), blank_to_null(rendered))


def tftp_write(host: str) -> Detector:
    return _hit((_int("tftp.opcode") == 2) & (source() == host), "TFTP", C.NOTE_TFTP_WRQ,
                command="WRQ", filename=tftp_filename())


def smb_write(host: str, threshold: int = C.LARGE_UPLOAD_BYTES) -> Detector:
    """Create and write commands from the host; the older protocol wins when both are present."""
    is_smb = F.col("smb").isNotNull()
    cmd = F.when(is_smb, F.concat(F.lit("1:"), F.col("smb.cmd"))).otherwise(
        F.concat(F.lit("2:"), F.col("smb2.cmd")))
    rules = [
        (f"1:{C.SMB_NT_CREATE_ANDX}", "NT_CREATE_ANDX", F.col("smb.nt_create_andx_filename"), None),
        (f"1:{C.SMB_WRITE_ANDX}", "WRITE_ANDX", F.col("smb.file_name"), _int("smb.data_len")),
        (f"2:{C.SMB2_CREATE}", "CREATE", F.col("smb2.filename"), None),
        (f"2:{C.SMB2_WRITE}", "WRITE", None, _int("smb2.write_length")),
    ]
    pick = lambda position: F.coalesce(*[
        F.when(cmd == rule[0], rule[position]) for rule in rules if rule[position] is not None])
    command = F.coalesce(*[F.when(cmd == rule[0], F.lit(rule[1])) for rule in rules])
    name, size = strip(pick(2)), F.coalesce(pick(3), F.lit(0))
    proto = F.when(is_smb, "SMB").otherwise("SMB2")
    large = size >= threshold
    note = F.concat(
        proto, F.lit(" file upload command ("), command, F.lit(") from host"),
        F.when(name != "", F.concat(F.lit(" filename: "), name)).otherwise(""),
        F.when(large, C.NOTE_SMB_LARGE).otherwise(""))
    return _hit(command.isNotNull() & (source() == host), proto, note, command=command,
                filename=name, content_length=F.when(large, size))


def large_smtp(host: str, threshold: int = C.LARGE_UPLOAD_BYTES) -> Detector:
    """Large message without attachment; the bound itself is not large."""
    body = smtp_body(F.col("smtp"), F.col("tcp"), F.col("data"))
    # The size of a large message without attachment, else NULL.
    bare = lambda b: F.when(
        (F.octet_length(b) > threshold) & (F.size(mail_attachments(to_latin1(b))) == 0), F.octet_length(b))
    size = let(body, bare)
    return _hit(F.col("smtp").isNotNull() & (source() == host) & size.isNotNull(),
                "SMTP", C.NOTE_SMTP_LARGE, size=size)


def long_dns_name(limit: int = C.LONG_QNAME_CHARS) -> Detector:
    name = dns_name(F.col("dns.qname"))
    return _hit(is_dns_query() & (F.length(name) > limit), "DNS", C.NOTE_DNS_LONG, qname=name)


def header_detectors(host: str) -> list[Detector]:
    """The detectors that read no bodies."""
    return [large_http(host), disposition_seen(), ftp_upload(host), ftp_filename(host),
            tftp_write(host), smb_write(host), long_dns_name()]


def stateless_detectors(host: str) -> list[Detector]:
    return [*header_detectors(host), large_smtp(host)]


def findings(packets: DataFrame, *detectors: Detector) -> DataFrame:
    """Findings of all given detectors in one pass over the packets."""
    any_holds = reduce(lambda a, b: a | b, [d.condition for d in detectors])
    hits = F.filter(F.array(*[F.when(d.condition, d.finding) for d in detectors]), lambda f: f.isNotNull())
    return packets.filter(any_holds).select(F.explode(hits).alias("f")).select("f.*")


def flow_finding(totals: DataFrame, threshold_mb: float = C.FLOW_THRESHOLD_MB) -> DataFrame:
    """One finding when the host's outbound bytes exceed the threshold."""
    note = F.concat(F.lit(C.NOTE_FLOW), human_bytes(F.col("bytes_from_host")))
    return (
        totals.filter(F.col("bytes_from_host") > threshold_mb * 1024 * 1024)
        .select(finding(proto=F.lit("FLOW"), note=note).alias("f")).select("f.*")
    )


def rejects(packets: DataFrame) -> DataFrame:
    """Per detector, how many packets carry a value its rule cannot read."""
    bad = lambda field: F.count_if(F.col(field).isNotNull() & _int(f"trim({field})").isNull())
    return packets.agg(
        bad("http.content_length").alias("http_content_length"),
        bad("tftp.opcode").alias("tftp_opcode"), bad("smb.data_len").alias("smb_data_len"),
        bad("smb2.write_length").alias("smb2_write_length"), bad("dns.qr").alias("dns_qr"))


def sample_findings(found: DataFrame, k: int = C.SUMMARY_FINDINGS) -> DataFrame:
    return found.orderBy("capture_id", "frame_no", "proto", "note").limit(k)


