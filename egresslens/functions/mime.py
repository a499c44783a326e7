"""Multipart and mail bodies: boundaries, parts, headers, file names, payloads.

Bodies are Latin-1 text inside these expressions, so every byte survives; only header values
are read as UTF-8.
"""

from pyspark.sql import Column, functions as F

from egresslens import constants as C
from egresslens.functions.binary import (
    decode_hex, from_latin1, latin1_to_utf8, non_empty, sha256, split_literal, utf8_to_latin1,
)
from egresslens.functions.text import blank_to_null, let, strip

CRLF2, LF2 = "\r\n\r\n", "\n\n"
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def _trim_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[\r\n]+|[\r\n]+\z", "")


def http_boundary(content_type: Column) -> Column:
    """Boundary of a content type: rest of the line, trimmed, one pair of quotes removed."""
    def unquoted(raw: Column) -> Column:
        quoted = F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"'))
        inner = F.substring(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0)))
        return blank_to_null(F.when(quoted, inner).otherwise(raw))

    return let(strip(_first(content_type, C.RE_BOUNDARY_HTTP)), unquoted)


def split_parts(body: Column, separator: Column) -> Column:
    """Parts between separators, leading line ends removed, empty and closing ones dropped."""
    pieces = F.transform(
        split_literal(body, separator), lambda p: F.regexp_replace(p, r"\A[\r\n]+", "")
    )
    return F.filter(pieces, lambda p: (p != "") & (p != "--"))


def multipart_parts(body: Column, boundary: Column) -> Column:
    return split_parts(body, F.concat(F.lit("--"), utf8_to_latin1(boundary)))


def part_header_lines(part: Column) -> Column:
    """``array<struct<key,value>>`` of the header lines in order, keys in lower case."""
    end = F.when(F.instr(part, CRLF2) > 0, F.instr(part, CRLF2)).otherwise(F.instr(part, LF2))
    raw = let(end, lambda e: F.when(e > 0, F.substring(part, F.lit(1), e - 1)).otherwise(""))
    lines = F.filter(F.split(latin1_to_utf8(raw), LINE_ENDS), lambda line: F.contains(line, F.lit(":")))
    return F.transform(lines, lambda line: F.struct(
        F.lower(strip(F.substring_index(line, ":", 1))).alias("key"),
        strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"),
    ))


def part_headers(part: Column) -> Column:
    """Headers as a map; the last of repeated headers counts."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(part_header_lines(part), empty, lambda acc, line: F.map_concat(
        F.map_filter(acc, lambda key, _: key != line["key"]),
        F.create_map(line["key"], line["value"]),
    ))


def _value_of(lines: Column, key: str) -> Column:
    same = F.filter(lines, lambda line: line["key"] == key)
    return blank_to_null(F.try_element_at(same, F.lit(-1))["value"])


def header_value(part: Column, key: str) -> Column:
    return _value_of(part_header_lines(part), key)


def part_body(part: Column) -> Column:
    """Body after the blank line, without exactly one closing CRLF."""
    rest = lambda start: F.substring(part, start, F.length(part))
    body = (F.when(F.instr(part, CRLF2) > 0, rest(F.instr(part, CRLF2) + 4))
            .when(F.instr(part, LF2) > 0, rest(F.instr(part, LF2) + 2)))
    closed = let(body, lambda b: F.when(
        F.endswith(b, F.lit("\r\n")), F.substring(b, F.lit(1), F.length(b) - 2)).otherwise(b))
    return F.coalesce(closed, part)


def disposition_filename(text: Column) -> Column:
    return _first(text, C.RE_FILENAME)


def _part_file(name: Column, data: Column) -> Column:
    return F.struct(name.alias("filename"), from_latin1(data).alias("data"))


def multipart_files(body: Column, content_type: Column) -> Column:
    """``array<struct<filename,data>>`` of the parts that carry a file name."""
    parts = multipart_parts(body, http_boundary(content_type))
    named = F.transform(parts, lambda p: F.struct(
        disposition_filename(header_value(p, "content-disposition")).alias("name"), p.alias("part")))
    files = F.filter(named, lambda f: f["name"].isNotNull())
    return F.transform(files, lambda f: _part_file(f["name"], part_body(f["part"])))


def peel(body: Column) -> Column:
    """Content of the first file part of a dashed multipart wrapper, or the body unchanged."""
    boundary = _first(body, C.RE_DASH_BOUNDARY, 0)
    hits = F.filter(let(boundary, lambda b: split_literal(body, b)), lambda p: (
        F.contains(p, F.lit("Content-Disposition:")) & F.contains(p, F.lit("filename="))
        & F.contains(p, F.lit(CRLF2))
    ))
    inner = let(F.try_element_at(hits, F.lit(1)), lambda p: _trim_newlines(
        F.substring(p, F.instr(p, CRLF2) + 4, F.length(p))))
    return F.coalesce(inner, body)


def http_body(http: Column, tcp: Column, data: Column) -> Column:
    """First of the body carrying fields that decodes to something."""
    return F.coalesce(
        non_empty(decode_hex(http["file_data"])), non_empty(decode_hex(http["payload"])),
        non_empty(decode_hex(tcp["payload"])), non_empty(decode_hex(data["data"])),
    )


def smtp_body(smtp: Column, tcp: Column, data: Column) -> Column:
    """Message field as hex, else as plain text, then the transport payloads."""
    fields = []
    for name in ("data", "line", "payload"):
        value = blank_to_null(smtp[name])
        fields += [non_empty(decode_hex(value)), F.encode(value, "UTF-8")]
    return F.coalesce(
        *fields, non_empty(decode_hex(tcp["payload"])), non_empty(decode_hex(data["data"]))
    )


def decode_base64_text(text: Column) -> Column:
    """Bytes of base64 text longer than 100 characters, else NULL.

    A sequence that ends inside a group of four without its padding is not decoded.
    """
    def padded(joined: Column, core: Column) -> Column:
        pads = F.length(F.regexp_extract(joined, r"\A[A-Za-z0-9+/]*(=*)", 1))
        tail = F.length(core) % 4
        return (
            F.when((tail == 0) & (F.length(core) + pads == F.length(joined)), core)
            .when((tail == 2) & (pads >= 2), F.concat(core, F.lit("==")))
            .when((tail == 3) & (pads >= 1), F.concat(core, F.lit("="))))

    def decoded(joined: Column) -> Column:
        core = F.regexp_extract(joined, r"\A[A-Za-z0-9+/]*", 0)
        return F.try_to_binary(let(core, lambda c: padded(joined, c)), F.lit("base64"))

    looks = lambda clean: (F.length(clean) > 100) & clean.rlike(r"\A[A-Za-z0-9+/=\s]+\z")
    return let(strip(text), lambda clean: F.when(
        looks(clean), non_empty(let(F.regexp_replace(clean, r"\s", ""), decoded))))


def _attachment(part: Column) -> Column:
    encoded = F.contains(part, F.lit("Content-Transfer-Encoding:")) & F.contains(
        F.lower(part), F.lit("base64"))
    name = let(part_header_lines(part), lambda lines: F.coalesce(
        disposition_filename(_value_of(lines, "content-disposition")),
        _first(_value_of(lines, "content-type"), C.RE_NAME_PARAM)))
    data = let(_trim_newlines(part_body(part)), lambda raw: F.coalesce(
        decode_base64_text(latin1_to_utf8(raw)), from_latin1(raw)))
    fallback = lambda d: F.concat(F.lit("smtp_attach_"), F.substring(sha256(d), 1, 8), F.lit(".bin"))
    file = lambda n: let(data, lambda d: F.struct(
        F.coalesce(n, fallback(d)).alias("filename"), d.alias("data")))
    return let(name, lambda n: F.when(n.isNotNull() | encoded, file(n)))


def _inline_file(message: Column) -> Column:
    """File name anywhere in a message without boundary; content follows its last occurrence."""
    name = latin1_to_utf8(_first(message, C.RE_FILENAME))
    tail = let(_first(message, C.RE_FILENAME, 0), lambda matched: _trim_newlines(
        F.call_function("substring_index", message, matched, F.lit(-1))))
    return let(tail, lambda t: F.when(t != "", _part_file(name, t)))


def _headerless_file(message: Column) -> Column:
    name = latin1_to_utf8(_first(message, C.RE_FILENAME))
    tail = F.element_at(F.split(message, CRLF2), -1)
    return F.when(message.rlike(C.RE_DISPOSITION) & name.isNotNull(), _part_file(name, tail))


def _one_or_none(item: Column) -> Column:
    return F.filter(F.array(item), lambda x: x.isNotNull())


def mail_attachments(message: Column) -> Column:
    """``array<struct<filename,data>>`` of the attachments of a Latin-1 message."""
    return let(message, _attachments_of)


def _attachments_of(message: Column) -> Column:
    end = F.instr(message, CRLF2)
    head = F.substring(message, F.lit(1), F.greatest(end - 1, F.lit(0)))
    body = F.substring(message, end + 4, F.length(message))
    separator = lambda b: F.when(F.startswith(b, F.lit("--")), b).otherwise(F.concat(F.lit("--"), b))
    attached = lambda b: F.filter(
        F.transform(split_parts(body, separator(b)), _attachment), lambda x: x.isNotNull())
    with_end = lambda b: F.when(b.isNotNull(), attached(b)).otherwise(_one_or_none(_inline_file(message)))
    return (
        F.when(end > 0, let(_first(head, C.RE_BOUNDARY_MIME), with_end))
        .when(message != "", _one_or_none(_headerless_file(message)))
        .otherwise(F.array().cast("array<struct<filename:string,data:binary>>")))
