"""Fixed schemas of the engine's tables (a missing attribute is NULL)."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType,
    StructField, StructType, TimestampType,
)

STR, INT, LONG, DBL = StringType(), IntegerType(), LongType(), DoubleType()
BIN, BOOL, TS = BinaryType(), BooleanType(), TimestampType()


def struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def strings(*names: str) -> StructType:
    return struct(**{name: STR for name in names})


RESOURCE_RECORD = struct(section=STR, name=STR, type=INT, ttl=LONG, rdata=STR)

_LAYERS = dict(
    eth=strings("src", "dst"),
    ip=strings("src", "dst"),
    ipv6=strings("src", "dst"),
    tcp=struct(srcport=INT, dstport=INT, payload=STR),
    udp=struct(srcport=INT, dstport=INT),
    http=strings("request_method", "content_length", "content_type", "content_disposition",
                 "response_code", "file_data", "payload"),
    ftp=strings("request_command", "request_arg"),
    tftp=strings("opcode", "filename", "destination_file", "text", "block", "data"),
    smb=strings("cmd", "nt_create_andx_filename", "file_name", "data_len"),
    smb2=strings("cmd", "filename", "write_length"),
    smtp=strings("command", "data", "line", "payload"),
    dns=struct(qr=STR, qname=STR, rr=ArrayType(RESOURCE_RECORD)),
    data=strings("data"),
)

#: Frames are numbered within a capture; a packet is known by ``capture_id`` and ``frame_no``. Packets
#: without a ``capture_id`` form one capture.
PACKETS = struct(capture_id=STR, frame_no=LONG, ts=TS, length=LONG, **_LAYERS)
# As exported by a capture tool: the frame length is text and may be damaged.
RAW_PACKETS = struct(capture_id=STR, frame_no=LONG, ts=TS, length=STR, **_LAYERS)

FINDING = struct(
    proto=STR, command=STR, method=STR, src=STR, dst=STR, filename=STR, saved_as=STR,
    saved_path=STR, content_length=LONG, size=LONG, qname=STR, classification=STR, p1=DBL,
    p2=DBL, subdomain=INT, entropy=DBL, note=STR, capture_id=STR, frame_no=LONG,
)

PACKET_INFO = strings("src", "dst", "method", "proto")
OBJECT = struct(
    capture_id=STR, frame_no=LONG, part_no=INT, original_filename=STR, size=LONG, sha256=STR, filetype=STR,
    proto=STR, note=STR, pkt=PACKET_INFO, payload=BIN,
)

TARGETS = strings("path", "sha256", "md5", "ssdeep", "tlsh", "ftype")

FILES = struct(
    path=STR, size=LONG, ftype=STR, sha256=STR, md5=STR, ssdeep=STR, tlsh=STR, deleted=BOOL,
    partition_offset=LONG,
)

REPORT = strings("Section", "Key", "Value")

USB_EVENT = struct(
    kind=STR, timestamp=STR, vendor=STR, product=STR, manufacturer=STR, description=STR,
    serial=STR, device_name=STR, instance=STR, values=MapType(STR, STR),
)

NETWORK_MATCH = struct(name=STR, size=LONG, sha256=STR, md5=STR, ftype=STR)


def conform(df: DataFrame, schema: StructType, **columns) -> DataFrame:
    """Project ``df`` onto ``schema``: given columns, else same-named ones, else NULL."""
    picked = []
    for field in schema.fields:
        if field.name in columns:
            value = columns[field.name]
        elif field.name in df.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        picked.append(value.cast(field.dataType).alias(field.name))
    return df.select(*picked)


def capture_of(df: DataFrame):
    """The capture of each row; NULL, the unnamed capture, where the table names none."""
    return (F.col("capture_id") if "capture_id" in df.columns else F.lit(None).cast("string")).alias("capture_id")


def layer(name: str, schema: StructType = PACKETS, **values):
    """A packet layer struct with the given fields set and the others NULL."""
    fields = schema[name].dataType.fields
    unknown = set(values) - {f.name for f in fields}
    if unknown:
        raise KeyError(f"unknown {name} fields: {sorted(unknown)}")
    return F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields
    ])


def require_columns(df: DataFrame, names) -> None:
    """Raise ``KeyError`` unless ``df`` has every named column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise KeyError(f"missing required columns: {missing}")
