"""Row filters and projections over packets and file inventories."""

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from egresslens import constants as C
from egresslens.session import materialize


def source() -> Column:
    """Source address, IPv4 before IPv6."""
    return F.coalesce(F.col("ip.src"), F.col("ipv6.src"))


def destination() -> Column:
    return F.coalesce(F.col("ip.dst"), F.col("ipv6.dst"))


def host_layer(host: str) -> str:
    """Which packet layer a host literal is compared with: ip, ipv6 or eth."""
    try:
        version = ipaddress.ip_address(host).version
    except ValueError:
        return "eth"
    return "ip" if version == 4 else "ipv6"


def host_filter(packets: DataFrame, host: str) -> DataFrame:
    """Packets with the host on either side; the plain comparison reaches the file scan."""
    name = host_layer(host)
    return packets.filter((F.col(f"{name}.src") == host) | (F.col(f"{name}.dst") == host))


def expression_filter(packets: DataFrame, expression: str) -> DataFrame:
    return packets.filter(F.expr(expression))


def is_true(condition: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def drop_smb_reads(packets: DataFrame) -> DataFrame:
    read = (F.col("smb.cmd") == C.SMB_READ_ANDX) | (F.col("smb2.cmd") == C.SMB2_READ)
    return packets.filter(~is_true(read))


def dns_port_filter(packets: DataFrame) -> DataFrame:
    ports = [F.col(f"{proto}.{side}") == 53 for proto in ("udp", "tcp") for side in ("srcport", "dstport")]
    return packets.filter(F.col("dns").isNotNull() & is_true(reduce(lambda a, b: a | b, ports)))


def has_layer(packets: DataFrame, *names: str) -> DataFrame:
    return packets.filter(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))


def is_dns_query() -> Column:
    return F.expr("try_cast(dns.qr AS int)") == 0


def dns_queries(packets: DataFrame) -> DataFrame:
    return packets.filter(is_dns_query())


def direction(host: str) -> Column:
    """``out``, ``in`` or NULL; a packet to oneself counts as outbound."""
    return F.when(source() == host, "out").when(destination() == host, "in")


def allocated(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("deleted"))


def deleted(files: DataFrame) -> DataFrame:
    return files.filter(F.col("deleted"))


def non_empty_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("size") > 0)


def type_prefix_filter(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Files whose type starts with any target type; no target types means no filter.

    The prefix test runs once per distinct type: its prefixes are joined with the target types on
    equality, and the files then keep the types that passed.
    """
    wanted = targets.select(F.col("ftype").alias("prefix")).dropna().distinct()
    types = files.select("ftype").dropna().distinct()
    passed = (
        types.select("ftype", F.explode(F.transform(
            F.sequence(F.lit(0), F.length("ftype")), lambda n: F.substring("ftype", F.lit(1), n)
        )).alias("prefix"))
        .join(wanted, "prefix", "left_semi").select("ftype").distinct()
    )
    # written first, so that the small list is known by size and the files stay where they are
    kept = files.join(materialize(passed, "passed-types"), "ftype", "left_semi")
    if wanted.isEmpty():
        return files
    return kept.select(*files.columns)


def path_ends_with(suffixes) -> Column:
    path = F.lower(F.col("path"))
    return reduce(lambda a, b: a | b, [F.endswith(path, F.lit(s)) for s in suffixes])


def windows_hives(files: DataFrame) -> DataFrame:
    return files.filter(path_ends_with(C.WINDOWS_HIVE_SUFFIXES))


def linux_logs(files: DataFrame) -> DataFrame:
    return files.filter(path_ends_with(C.LINUX_LOG_SUFFIXES))


def usb_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").rlike(C.RE_USB_EVENT))


def report_rows(report: DataFrame, section: str = "ParsedFile") -> DataFrame:
    return report.filter((F.col("Section") == section) & F.col("Value").isNotNull())


def with_value(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column])


def without_usb_files(files: DataFrame, usb_events: DataFrame) -> DataFrame:
    """Files that yielded at least one device leave the hash stream."""
    bearing = usb_events.select(F.col("file").alias("path")).distinct()
    return files.join(bearing, "path", "left_anti")


def keep_known(df: DataFrame, names) -> DataFrame:
    """Project the named columns that exist."""
    return df.select(*[n for n in names if n in df.columns])
