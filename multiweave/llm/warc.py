"""WARC archives: a writer of record-per-member gzip files, and a reader that splits them.

The reader gives tasks byte ranges. A task scans its range for the magic bytes of a gzip member, accepts a candidate only
if the bytes from there inflate to a WARC version line and a header block with a record type and a content length, and
then owns every record whose member starts inside its range, reading past the end of the range to finish the last one.
Ranges thus need no index, and any range can be read again by itself when an executor is lost. Magic bytes inside a
compressed member do not inflate to a WARC header, so they are passed over.

Records with equal payloads: that of the largest page_id is the response, the others are revisits that refer to it and
carry no payload; payloads smaller than `least` bytes are always responses. Archives are Hadoop-style URIs that pyarrow
can open (file:, hdfs:, s3: and so on); listing goes through Spark.

Defined results: a null html is an empty payload. Of rows with the same payload and page_id (repeated rows) each that
has the largest page_id is a response; rows with a null page_id are responses with no identity and nothing refers to
them. Empty tables give no archives and no rows. Any length of payload is written whole, in one member.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete_path, shared_path, table

MAGIC = b"\x1f\x8b\x08"
SPLIT, READ, HEAD = 4 << 20, 1 << 20, 64 << 10
LEAST = 0
#: Payloads with copies whose digests are broadcast at most, of some 60 bytes each; beyond, a shuffle join.
BROADCAST_ROWS = 500_000
#: Ranges that a task of the reader has at most.
RANGES = 64
READ_SCHEMA = "path string, at long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}" if uri.startswith(("/", "file:")) else uri)


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{page}>"


def page_of(record: str | None) -> int | None:
    value = (record or "").removeprefix("<urn:page:").rstrip(">")
    return int(value) if value.lstrip("-").isdigit() else None


def member(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """A gzip member with one record: a response with its payload, or a revisit with the head of its reply alone."""
    reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = reply if revisit else reply + payload
    target = "".join(c if c.isprintable() and not c.isspace() else "" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Writes an archive for each task under folder, and returns (archive, records) of those written.

    A task writes to a file of its own and names it by its partition at its end, so a partition that runs twice leaves one whole archive.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(page_id).cast("long").alias("__page"), F.col(url).cast("string").alias("__url"), body.alias("__body"))
    keyed = base.withColumn("__sha", F.sha1("__body"))
    known = keyed.filter(F.col("__page").isNotNull() & (F.octet_length("__body") >= least))
    shared = known.groupBy("__sha").agg(F.max("__page").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").select("__sha", "__first")
    shared = cut(shared)  # payloads that stand more than once
    rows = keyed.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "__sha", "left").select("__page", "__url", "__body", "__sha", "__first")
    return rows.mapInArrow(_writer(folder, least), "archive string, records long")


def _writer(folder: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}"
        own = f"{name}.{uuid.uuid4().hex}.open"
        out, n = None, 0
        try:
            for batch in batches:
                for page, url, body, sha, first in zip(*batch.columns, strict=True):
                    page, body, first = page.as_py(), body.as_py(), first.as_py()
                    revisit = first is not None and page is not None and page != first and len(body) >= least
                    if out is None:
                        out = system.open_output_stream(own, compression=None)
                    out.write(member(page, url.as_py(), body, base64.b32encode(bytes.fromhex(sha.as_py())).decode(), first, revisit))
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            if system.get_file_info(f"{name}.warc.gz").is_file:
                system.delete_file(f"{name}.warc.gz")
            system.move(own, f"{name}.warc.gz")
            yield pa.record_batch([pa.array([f"{name}.warc.gz"]), pa.array([n])], ["archive", "records"])

    return run


def head_of(pieces: Iterable[bytes]) -> dict[str, str] | None:
    """The header fields of the WARC record that the gzip member at the start of pieces holds, or None if there is none. Reads as far as the header goes."""
    unpack, text = zlib.decompressobj(31), bytearray()
    for piece in pieces:
        while True:
            try:
                got = unpack.decompress(piece, HEAD)
            except zlib.error:
                return None
            text += got
            if not text.startswith(b"WARC/1."[: len(text)]):
                return None
            if (end := text.find(b"\r\n\r\n", max(0, len(text) - len(got) - 3))) >= 0:
                return _fields(bytes(text[:end]))
            if unpack.eof:
                return None
            piece = unpack.unconsumed_tail
            if not piece and len(got) < HEAD:
                break
    return None


def _fields(head: bytes) -> dict[str, str] | None:
    if not head.startswith(b"WARC/1."):
        return None
    out = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        out[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out if "warc-type" in out and out.get("content-length", "").isdigit() else None


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of the records whose members start in [start, end) of an open random-access file."""
    at, window, base = start, b"", start
    while at < end:
        if at + len(MAGIC) > base + len(window):  # the scan has used up what was read
            base, window = at, source.read_at(min(READ, size - at), at) if at < size else b""
            if len(window) < len(MAGIC):
                return
        k = window.find(MAGIC, at - base)
        if k < 0:
            at = base + len(window) - len(MAGIC) + 1
            if base + len(window) >= size:
                return
            continue
        at = base + k
        if at >= end:
            return
        if base + len(window) - at < HEAD and base + len(window) < size:
            base, window = at, source.read_at(min(READ, size - at), at)
        more = (source.read_at(min(READ, size - to), to) for to in range(at + HEAD, size, READ))
        head = head_of(itertools.chain([window[at - base : at - base + HEAD]], more))
        if head is None:
            at += 1
            continue
        unpack, parts, to = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = window[to - base : to - base + READ] if base <= to < base + len(window) else source.read_at(min(READ, size - to), to)
            if not piece:
                raise ValueError(f"the record at {at} is cut off")
            parts.append(unpack.decompress(piece))
            to += len(piece)
        to -= len(unpack.unused_data)
        text = b"".join(parts)
        body = text.find(b"\r\n\r\n") + 4
        yield at, head, text[body : body + int(head["content-length"])]
        at = to


def read(spark: SparkSession, folder: str, *, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """The records of the archives (*.warc.gz) in folder; payload=False leaves the bodies out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("at"))
    n = starts.count()  # of the listing
    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism), -(-n // RANGES))
    ranges = starts.repartition(tasks)  # a range a row, dealt evenly; ranges are of one size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for path, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = filesystem(path)
                rows, held = [], 0
                with system.open_input_file(name) as source:
                    for place, head, block in records_in(source, length, at, min(at + split, length)):
                        row = _row(path, place, head, block, payload)
                        rows.append(row)
                        held += len(block) if payload else 0
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return ranges.mapInArrow(run, READ_SCHEMA)


def _row(path: str, place: int, head: dict, block: bytes, payload: bool) -> tuple:
    end = block.find(b"\r\n\r\n")
    reply, body = block[:end], block[end + 4 :]
    revisit = head["warc-type"] == "revisit"
    said = next((int(v) for k, _, v in (x.partition(b":") for x in reply.split(b"\r\n")) if k.strip().lower() == b"content-length"), 0)
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else sha1_32(body)
    if not revisit and head.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
        raise ValueError(f"{path}, {place}: the payload does not have the digest that its header names")
    return path, place, head["warc-type"], head.get("warc-record-id"), head.get("warc-target-uri"), said if revisit else len(body), digest, head.get("warc-refers-to"), body if payload and not revisit else None


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    written = write(pages, folder).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    out = cut(read(spark, folder, payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")))
    delete_path(spark, folder)
    if (n := out.count()) != written:
        raise ValueError(f"{written} records were written, and {n} read")
    return out
