"""WARC archives compressed with Zstandard: dictionary frame first, one frame per record.

The dictionary lies in a skippable frame at the head of each archive
(magic 0x184D2A5D). Readers load it, decode frame by frame, and validate each
record's headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, fresh

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, uri: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record. A revisit holds the HTTP headers alone; both kinds name the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((uri or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The record as a dict; :class:`WarcError` if a header, a length or a digest is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC version line")
    fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not fields.get(k)]
    if missing:
        raise WarcError(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, not {n}")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP headers")
    lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not lengths or not digest.startswith("sha1:"):
        raise WarcError("unknown type, or no length or digest of the payload")
    full, sha1 = int(lengths[0]), base64.b32decode(digest[5:])
    if kind == "response" and (len(payload) != full or hashlib.sha1(payload).digest() != sha1):
        raise WarcError("the payload's length or digest is wrong")
    if kind == "revisit" and (payload or not fields.get("warc-refers-to")):
        raise WarcError("a revisit holds a payload or refers to nothing")
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields.get("x-page-id")), "uri": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": full, "payload_digest": sha1.hex(), "refers_to": number(fields.get("x-refers-to-page-id")), "payload": payload}


def read_archive(data: bytes | memoryview) -> Iterator[dict]:
    """The records of an archive, one frame at a time."""
    at, context = 0, zstandard.ZstdDecompressor()
    data = memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("the archive ends within a frame")
        magic, n = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # any skippable frame
            body = bytes(data[at + 8 : at + 8 + n])
            if len(body) != n:
                raise WarcError("the archive ends within a skippable frame")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise WarcError("the dictionary isn't the first frame")
                body = zstandard.ZstdDecompressor().decompress(body) if body[:4] == struct.pack("<I", ZSTD_MAGIC) else body
                context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + n
            continue
        frame = context.decompressobj()
        try:
            raw = frame.decompress(data[at:])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from e
        if not frame.eof:
            raise WarcError("the archive ends within a frame")
        at = len(data) - len(frame.unused_data)
        yield parse_record(raw)


def train_dictionary(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample_rows: int = 256, sample_bytes: int = 32_768, dict_bytes: int = 32_768) -> bytes:
    """A dictionary from at most ``sample_rows`` payloads of at most ``sample_bytes`` each; empty if too few.

    Rows are drawn by a hash first, about four times as many as are needed, so
    that no task sends more than its share of them to the driver.
    """
    sample = pages.select(F.encode(F.col(html), "UTF-8").alias("b"), F.xxhash64(F.col(page_id), F.col(html)).alias("h")).where(F.octet_length("b").between(1, sample_bytes))
    n = sample.count()
    if n > 8 * sample_rows:
        sample = sample.where(F.pmod("h", F.lit(1 << 40)) < (1 << 40) * 4 * sample_rows // n)
    rows = [bytes(r.b) for r in sample.orderBy("h", "b").limit(sample_rows).collect()]
    try:
        return zstandard.train_dictionary(dict_bytes, rows).as_bytes() if len(rows) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 1000, archive_bytes: int = 8 << 20, dictionary: bytes = b"", level: int = 3) -> DataFrame:
    """Writes ``path``/NNNNN-NNNN.warc.zst and returns (archive, records, bytes).

    Of rows with equal payloads of at least ``revisit_from`` bytes the largest
    page id becomes a response and the others revisits of it. Only digests and
    ids are grouped; a digest that many rows share is joined back by a join
    that Spark can split. Null html is an empty payload. Archives close at
    ``archive_bytes``. A file appears under its name only when complete, and a
    repeated task writes the same name again.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    groups = rows.where((F.octet_length("payload") >= revisit_from) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        context = zstandard.ZstdCompressor(level=level, dict_data=zdict, write_content_size=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        task, number, frames, size, done = TaskContext.get(), 0, [], 0, []

        def close() -> None:
            nonlocal number, frames, size
            name = f"{base}/{task.partitionId():05d}-{number:04d}.warc.zst"
            draft = f"{base}/_{task.partitionId():05d}-{number:04d}-{task.taskAttemptId()}"
            with fs.open_output_stream(draft) as f:
                f.write(head)
                for x in frames:
                    f.write(x)
            fs.move(draft, name)
            done.append((name.rsplit("/", 1)[1], len(frames), size + len(head)))
            number, frames, size = number + 1, [], 0

        for batch in batches:
            for i, u, p, d, r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                frames.append(context.compress(make_record(i, u, p, d, r)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    close()
        if frames:
            close()
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    pafs_uri, base = pafs.FileSystem.from_uri(path)
    pafs_uri.create_dir(base, recursive=True)
    return cut(rows.mapInArrow(write, "archive string, records long, bytes long"), "warc-list")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``; with ``payload=False`` that column is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], list(names))

        for b in batches:
            for blob in b.column(0):
                rows, size = [], 0
                for r in read_archive(blob.as_buffer()):
                    size += len(r["payload"])
                    rows.append(r if payload else r | {"payload": None})
                    if len(rows) >= 2000 or payload and size >= 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(read, READ_SCHEMA)


def round_trip(pages: DataFrame, payload: bool = False, **options) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the archives back, validated.

    Repeated rows give repeated records; a repeated page id that holds the
    response's payload is a response too. An empty table gives no records.
    """
    spark = pages.sparkSession
    path = fresh(spark, "warc")
    options.setdefault("dictionary", train_dictionary(pages))
    listed = write_archives(pages, path, **options)
    if listed.isEmpty():
        return spark.createDataFrame([], READ_SCHEMA)
    return read_archives(spark, path, payload)
