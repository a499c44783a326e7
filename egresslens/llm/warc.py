"""WARC archives: a writer and a sequential reader.

Archives hold one gzip member per record. The first page with a payload gives a response record, all
other pages with an equal payload give revisit records that name the response by its id and repeat
its length and digest but not its bytes. The reader walks an archive once: it inflates member by member from
fixed-size reads, parses the record's header, takes the block by its Content-Length, hashes the
payload as it passes and compares length and digest with the header. Neither side holds more than one record.

Each task writes one archive under a temporary name and renames it when it is complete, so a task
that runs again leaves no half archive and the manifest lists only finished ones. Archives lie in the
shared folder; the folder is reached through ``pyarrow.fs``.

Defined results: a null html is an empty payload. The response among equal payloads is the one with
the smallest page_id; rows that repeat that id are responses too, and a null id comes last (if all
ids are null, all are responses). Other columns play no part.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from egresslens.llm.common import map_batches
from egresslens.session import materialize, work_path

READ = 1 << 18
ID_PREFIX = "urn:page:"
DATE = "2000-01-01T00:00:00Z"


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha, size, refers_to); refers_to and no payload for revisits."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # only digests that occur again are joined; html moves once
    first = (rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("sha", "first"))
    joined = rows.join(materialize(first, "repeated-payloads"), "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "sha",
                         F.length("payload").cast("long").alias("size"),
                         F.when(again, F.col("first")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes | None, sha: str, size: int, refers_to) -> bytes:
    """One record: header, blank line, block, two line ends."""
    digest = base64.b32encode(bytes.fromhex(sha)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{ID_PREFIX}{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame) -> DataFrame:
    """Write one archive per task below the shared folder and return the manifest (path, n_records)."""
    folder = work_path(pages.sparkSession, "warc")
    url = folder if "://" in folder else "file://" + folder

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(url)
        name, n, sink = None, 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(name + ".part", compression=None, buffer_size=READ)
                sink.write(member(record(*row)))
                n += 1
        if sink is not None:
            sink.close()
            fs.move(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([n], pa.int64())})

    manifest = map_batches(records(pages), run, "path string, n_records long")
    return materialize(manifest, "warc-manifest").withColumn("root", F.lit(url))


class Damaged(ValueError):
    """An archive that does not keep to the format or to its digests."""


def members(source) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as pieces of inflated bytes; take each to its end."""
    held = source.read(READ)
    while held:
        def pieces():
            nonlocal held
            inflate = zlib.decompressobj(31)
            while not inflate.eof:
                if not held:
                    held = source.read(READ)
                    if not held:
                        raise Damaged("the archive ends within a member")
                out = inflate.decompress(held, READ)
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out
        yield pieces()
        held = held or source.read(READ)


def _head(parts: Iterator[bytes], held: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, fields and the bytes read beyond the blank line."""
    while b"\r\n\r\n" not in held:
        more = next(parts, None)
        if more is None:
            raise Damaged("a header without end")
        held += more
    head, _, rest = held.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def _length(fields: dict[str, str]) -> int:
    try:
        return int(fields["content-length"])
    except (KeyError, ValueError) as error:
        raise Damaged("no readable Content-Length") from error


def read_record(parts: Iterator[bytes]) -> dict:
    """Read and verify one record."""
    version, fields, held = _head(parts, b"")
    if not version.startswith("WARC/"):
        raise Damaged(f"no WARC record: {version[:20]!r}")
    missing = {"warc-type", "warc-record-id", "warc-block-digest", "warc-payload-digest"} - fields.keys()
    if missing:
        raise Damaged(f"a record without {', '.join(sorted(missing))}")
    left = _length(fields)
    whole = hashlib.sha1()

    def block():
        nonlocal left, held
        while left:
            if not held:
                held = next(parts, b"")
                if not held:
                    raise Damaged("a block shorter than its Content-Length")
            piece, held = held[:left], held[left:]
            left -= len(piece)
            whole.update(piece)
            yield piece

    body = block()
    _, http, rest = _head(body, b"")
    payload, size = hashlib.sha1(rest), len(rest)
    for piece in body:
        payload.update(piece)
        size += len(piece)
    held += b"".join(parts)
    if held != b"\r\n\r\n":
        raise Damaged("a record must end with two line ends")
    if fields["warc-block-digest"] != "sha1:" + base64.b32encode(whole.digest()).decode():
        raise Damaged("the block does not have its digest")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind, told = fields["warc-type"], _length(http)
    if kind == "response" and (digest != base64.b32encode(payload.digest()).decode() or size != told):
        raise Damaged("the payload does not have its digest or length")
    if kind == "revisit" and size:
        raise Damaged("a revisit record with a payload")
    return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": told, "payload_digest": digest,
            "record_type": kind, "refers_to": _page(fields.get("warc-refers-to", "")),
            "url": fields.get("warc-target-uri")}


def _page(name: str) -> int | None:
    name = name.strip("<>")
    return int(name.removeprefix(ID_PREFIX)) if name.startswith(ID_PREFIX) else None


COLUMNS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
           "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the listed archives; an archive with another number of records is damaged."""
    def run(batches):
        for batch in batches:
            for path, n, root in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, _ = pafs.FileSystem.from_uri(root)
                found = 0
                with fs.open_input_stream(path, compression=None, buffer_size=READ) as source:
                    rows = []
                    for parts in members(source):
                        rows.append(read_record(parts))
                        found += 1
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)
                if found != n:
                    raise Damaged(f"{path} has {found} records, not {n}")

    listed = manifest.select("path", "n_records", "root")
    spread = listed.repartition(max(1, listed.count()), "path")
    return map_batches(spread, run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                    "refers_to long, url string")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in COLUMNS.items()], names=list(COLUMNS))
