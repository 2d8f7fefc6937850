"""WARC archives and the monolithic gzip normaliser (operator 7).

``write_archives`` writes pages as WARC records, one whole-file gzip stream per
partition: compact, but without random access.  ``normalise`` inflates each such stream
once, a record at a time, rewrites every record as a gzip member of its own and writes a
sidecar of offsets beside the new file.  ``read_records`` opens records by offset.

Files are written under a name of the attempt and moved into place when complete, so a
task that runs again replaces whole files.  All paths lie below one shared folder, which
may be on any file system that Arrow opens.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import Scratch

LEAST_BYTES = 100  # equal payloads from this size on are written once
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
INDEX = "path string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path, and the path there; Hadoop's ``file:/x`` is ``/x``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload or, with ``refers_to``, a revisit without it."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
            ("WARC-Target-URI", re.sub(r"\s", "%20", url) if url else "about:blank"), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to)),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (what follows the HTTP head) of one record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = raw[end + 4:end + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4:]


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a gzip stream that comes in pieces (of one member or more), holding one record at a time."""
    inflate, buffer = zlib.decompressobj(31), bytearray()

    def ready() -> Iterator[bytes]:
        while (end := buffer.find(b"\r\n\r\n")) >= 0:
            size = re.search(rb"\r\nContent-Length: (\d+)", buffer[:end])
            if size is None:
                raise ValueError("a record without Content-Length")
            whole = end + 8 + int(size[1])  # both heads' ends and the block
            if len(buffer) < whole:
                return
            yield bytes(buffer[:whole])
            del buffer[:whole]

    for piece in chunks:
        while piece:
            buffer += inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            yield from ready()
    if buffer:
        raise ValueError(f"{len(buffer)} bytes after the last record")


def _pieces(f, size: int = 1 << 20) -> Iterator[bytes]:
    while piece := f.read(size):
        yield piece


def decide(pages: DataFrame) -> DataFrame:
    """``pages`` with payload_digest and refers_to: the smallest page_id with an equal payload of LEAST_BYTES or more.

    Only ids and digests are grouped; a digest is joined back where it occurs twice.  A
    null page_id is larger than any; rows that repeat the smallest id are all responses.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("_n"))
    large = p.where(F.col("_n") >= LEAST_BYTES).select("page_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    again = large.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(
        F.col("payload_digest").alias("_digest"), F.col("page_id").alias("_page"), F.col("first").alias("refers_to")).distinct()
    same = (F.col("payload_digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page"))
    return p.join(again, same, "left").select("page_id", "url", "html", "payload_digest", "refers_to")


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """(path, records): one gzip stream of records per partition, in order of page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name, n = f"{root}/pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        part = f"{name}.{uuid.uuid4().hex}"
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        with fs.open_output_stream(part, compression=None) as out:
            for b in batches:
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                    out.write(deflate.compress(record(page, url, (html or "").encode(), digest, refers)))
                    n += 1
            out.write(deflate.flush())
        if n:
            fs.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["path", "records"])
        else:
            fs.delete_file(part)

    return decided.sortWithinPartitions("page_id", "payload_digest").mapInArrow(run, "path string, records long")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """INDEX rows of the rewritten files; each also gets a sidecar ``.idx`` of the same lines, tab-separated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                name = path.removesuffix(".warc.gz") + ".members.warc.gz"
                part, rows, at = f"{name}.{uuid.uuid4().hex}", [], 0
                with fs.open_input_stream(path, compression=None) as f, fs.open_output_stream(part, compression=None) as out:
                    for raw in records_of(_pieces(f)):
                        member = gzip.compress(raw, LEVEL, mtime=0)
                        head, _ = parse(raw)
                        rows.append((name, at, len(member), head["WARC-Record-ID"], head["WARC-Type"]))
                        out.write(member)
                        at += len(member)
                fs.move(part, name)
                with fs.open_output_stream(f"{part}.idx", compression=None) as out:
                    out.write("".join("\t".join(map(str, r[1:])) + "\n" for r in rows).encode())
                fs.move(f"{part}.idx", f"{name}.idx")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "offset", "length", "record_id", "record_type"])

    return files.select("path").mapInArrow(run, INDEX)


def read_index(files: DataFrame, folder: str) -> DataFrame:
    """INDEX rows from the sidecars of rewritten ``files`` (path), as a reader finds them that was not there when they were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(f"{path}.idx", compression=None) as f:
                    rows = [(path, int(at), int(size), record, kind) for at, size, record, kind in (line.split("\t") for line in f.read().decode().splitlines())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "offset", "length", "record_id", "record_type"])

    return files.select("path").mapInArrow(run, INDEX)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """RECORDS rows, each record opened by its offset.  A response's digest is that of the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        name, f = None, None
        for b in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if path != name:
                    if f is not None:
                        f.close()
                    name, f = path, fs.open_input_file(path)
                f.seek(offset)
                head, payload = parse(gzip.decompress(f.read(length)))
                page = head.get("Page-ID")
                if head["WARC-Type"] == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest != head["WARC-Payload-Digest"].removeprefix("sha256:"):
                        raise ValueError(f"the payload of page {page} in {path} at {offset} is not what was written")
                else:
                    size, digest = int(head["Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                refers = head.get("Refers-To-Page-ID")
                rows.append((None if page is None else int(page), size, digest, head["WARC-Type"], None if refers is None else int(refers)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("path", "offset", "length").sortWithinPartitions("path", "offset").mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, normalise the archives, read every record back.

    Null html is an empty payload, a null url ``about:blank``; a null page_id stays null;
    repeated rows are records of their own; an empty table gives no rows.
    """
    keep = Scratch(pages.sparkSession, "warc")
    folder = f"{keep.path}/archives"
    files = keep.table("files", write_archives(decide(pages), folder))
    n = files.count()
    rewritten = keep.table("rewritten", normalise(files.repartition(max(n, 1)), folder).groupBy("path").agg(F.count(F.lit(1)).alias("records")))
    return read_records(read_index(rewritten.repartition(max(n, 1), "path"), folder), folder)
