"""Web archives: pages written as WARC records and read back record by record.

Each record is one gzip member.  A page whose payload another page has too is
written once as a response; the others become revisits that name it.  The reader
goes through an archive from front to back with incremental decompression, finds
a block's end by its declared length and checks digests, so its memory does not
grow with an archive or a record unless payloads are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.tables import checkpoint
from archivolt.session import scratch_folder

CHUNK = 1 << 20
#: A task begins a new archive after so many compressed bytes.
ARCHIVE = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[bytes]:
    """The bytes of one record; a revisit if ``refers_to`` is given."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if refers_to is None else b""
    block = hashlib.sha1(http)
    block.update(body)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url) if url else None), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(block.digest()).decode()}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + len(body))), ("Page-ID", None if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    yield head.encode()
    yield http
    for at in range(0, len(body), CHUNK):
        yield body[at:at + CHUNK]
    yield b"\r\n\r\n"


def gzip_member(parts: Iterator[bytes]) -> Iterator[bytes]:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    for part in parts:
        yield packer.compress(part)
    yield packer.flush()


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: the page that a record refers to, null for a response.

    Of equal payloads of ``least_bytes`` or more the smallest page_id is the
    response.  Rows that share it are responses alike, as is a payload without
    any id; another row without an id revisits like the others.  A null html is
    an empty payload.  Equal payloads are told by SHA-1, SHA-256 and length.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.struct(F.sha1(F.col("html").cast("binary")), F.sha2(F.col("html").cast("binary"), 256), F.octet_length("html"))
    first = rows.where(F.octet_length("html") >= least_bytes).select("page_id", key.alias("key")).groupBy("key").agg(
        F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("key", "original")
    # Payloads that occur once have no partner; only repeated ones are looked up.
    return rows.withColumn("key", key).join(first, "key", "left").select(
        "page_id", "url", F.col("html").cast("binary").alias("payload"), F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))


def as_uri(folder: str) -> str:
    """A path without a scheme is one of files; ``file:/x`` and ``file:///x`` are one."""
    scheme, colon, path = folder.partition(":")
    if not colon:
        return f"file://{folder}"
    return f"{scheme}://{path}" if not path.startswith("//") else folder


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page below ``folder``, a URI all executors can write to; returns ``path, records, bytes`` of each archive.

    An archive's name is drawn anew by every attempt of a task, and only those
    that the returned table names count: what a lost executor left half written
    is never read.  The table is kept with a checkpoint, so it is fixed.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    name, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                for part in gzip_member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())):
                    out.write(part)
                    size += len(part)
                records += 1
                if size >= ARCHIVE:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    return checkpoint(with_originals(pages, least_bytes).mapInArrow(work, "path string, records long, bytes long"))


def members(stream) -> Iterator[Iterator[bytes]]:
    """The decompressed chunks of each gzip member of a stream, in order."""
    data, over = stream.read(CHUNK), False

    def chunks():
        nonlocal data, over
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if not data:
                data = stream.read(CHUNK)
                if not data:
                    raise EOFError("the archive ends inside a record")
            part = unpacker.decompress(data, CHUNK)
            data = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            if part:
                yield part
        data = data or stream.read(CHUNK)
        over = not data

    over = not data
    while not over:
        own = chunks()
        yield own
        for _ in own:  # what the caller left
            pass


class _Reader:
    """Takes exact numbers of bytes from chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            part = next(self.chunks, None)
            if part is None:
                raise ValueError("a header has no end")
            self.held += part
        out, self.held = self.held[:at], self.held[at + len(mark):]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held:
                self.held = next(self.chunks, b"")
                if not self.held:
                    raise ValueError("a block is shorter than it says")
            part, self.held = self.held[:size], self.held[size:]
            size -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _digest(value: str | None) -> str | None:
    return value.partition(":")[2].upper() if value else None


def read_record(chunks: Iterator[bytes], payloads: bool = False) -> dict:
    """One record's fields; ``intact`` says that its digests hold and nothing follows its end."""
    source = _Reader(chunks)
    head = source.until(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block, payload, size, parts = hashlib.sha1(), hashlib.sha1(), 0, []
    http = b""
    inside = not fields.get("content-type", "").startswith("application/http")
    for part in source.take(int(fields["content-length"])):
        block.update(part)
        if not inside:
            http += part
            if (at := http.find(b"\r\n\r\n")) < 0:
                continue
            inside, part, http = True, http[at + 4:], http[:at]
        payload.update(part)
        size += len(part)
        if payloads:
            parts.append(part)
    ends = b"".join(source.take(4)) == b"\r\n\r\n" and not source.held and next(chunks, None) is None
    kind, said = fields.get("warc-type"), _digest(fields.get("warc-payload-digest"))
    own = base64.b32encode(payload.digest()).decode()
    whole = base64.b32encode(block.digest()).decode()
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("page-id"), "record_type": kind, "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"),
        "payload_bytes": size if kind != "revisit" else int(_fields(http).get("content-length", 0)), "payload_digest": said or own,
        "refers_to": number("refers-to-page-id"), "intact": ends and _digest(fields.get("warc-block-digest")) in (None, whole) and (kind == "revisit" or said in (None, own)),
        "payload": b"".join(parts) if payloads and kind != "revisit" else None,
    }


FIELDS = "page_id long, record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in ``archives (path, ...)``, see :func:`read_record`.

    An archive that ends inside a record, or holds something else, fails the
    job with its name; a record whose digest does not hold is marked.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [(f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", ")]

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in names], [n for n, _ in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, base = fs.FileSystem.from_uri(path)
                found, held = [], 0
                with where.open_input_stream(base, compression=None) as stream:
                    try:
                        for chunks in members(stream):
                            found.append(read_record(chunks, payloads))
                            held += len(found[-1]["payload"] or b"")
                            if len(found) >= 4096 or held >= 16 * CHUNK:
                                yield rows(found)
                                found, held = [], 0
                    except (EOFError, ValueError, zlib.error) as problem:
                        raise ValueError(f"{path}: {problem}") from problem
                if found:
                    yield rows(found)

    return archives.select("path").mapInArrow(work, FIELDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages into archives in the shared folder and returns the records that the reader finds there."""
    folder = as_uri(f"{scratch_folder(pages.sparkSession)}/warc")
    return read_archives(write_archives(pages, folder, least_bytes))
