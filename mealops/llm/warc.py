"""WARC archives with a two-level capture index (operator 8).

*Writing*: every task writes its records to WARC 1.1 files of its own in the
shared folder, each record a gzip member, and returns one index row per
record. A file name carries a token of the attempt, and only the rows of
attempts that ended well are kept, so a task that runs again leaves no wrong
entry. Of records with equal payloads of at least ``least`` bytes, the one
with the smallest page id is a ``response``; the others are ``revisit``
records without the payload that refer to it.

*Index*: index rows are sorted by reversed-host URL key (range partitions)
and cut into compressed blocks of ``block`` lines; each index file has a
sparse directory with the first key and place of its blocks, and the list of
the files' first keys (one entry per file) is level one.

*Reading*: a wanted key is placed in a file by binary search in level one;
the task of that file searches the directory, reads and unpacks one block by
range, and searches within the block. The places found are dealt by (file,
stripe) and the records read by range, in order of offset, with payload and
digest verified.

Files go through ``pyarrow.fs``, by the URI of the shared folder.

Defined cases: null html -> empty payload; payloads under ``least`` bytes are
all responses; null url -> empty key; a null page id is kept, and refers to
nothing; rows that repeat the smallest page id of a payload are all
responses; empty table -> empty result; extra columns are not carried.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_named, shared_folder, text_of, written

_URN = "urn:capture:page:"


_LINES_PER_FILE = 1_000_000        # index lines in a file ...
_LINES_PER_TASK = 200_000          # ... and looked up by a task


@dataclass(frozen=True)
class Archive:
    """Where the archive's files are, and the first key of each index file, in order."""

    folder: str
    first_keys: list[bytes]
    index_files: list[str]
    n_records: int = 0
    n_bytes: int = 0


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: ``http://a.b.com/x?y`` -> ``com,b,a)/x?y``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){tail}"


def sort_key(url: str | None, page: int | None) -> bytes:
    return f"{url_key(url)}\0{'' if page is None else page}".encode("utf-8", "replace")


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def record(kind: str, url: str | None, page: int | None, payload: bytes, digest: str, size: int,
           refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit holds no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_URN}{'' if page is None else page}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<{_URN}{refers_to}>")]
    head += [("X-Payload-Length", size), ("Content-Type", "application/http;msgtype=response"),
             ("Content-Length", len(body))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_URN)
    return int(number) if number else None


_ENTRY = pa.schema([("key", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ENTRY_SQL = "key binary, file string, offset long, length long"


def _writer(folder: str, date: str, roll: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        out, name, at, number = None, "", 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for page, url, kind, refers_to, size, digest, html in zip(*batch.columns, strict=True):
                page, url, kind = page.as_py(), url.as_py(), kind.as_py()
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    name = f"{TaskContext.get().partitionId():05d}-{number:03d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, at, number = store.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                    info = b"software: mealops\r\nformat: WARC File Format 1.1\r\n"
                    at += out.write(gzip.compress(
                        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
                        f"WARC-Date: {date}\r\nContent-Type: application/warc-fields\r\n"
                        f"Content-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", level))
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                raw = gzip.compress(record(kind, url, page, payload, digest.as_py(), size.as_py(),
                                           refers_to.as_py(), date), level, mtime=0)
                out.write(raw)
                rows.append((sort_key(url, page), name, at, len(raw)))
                at += len(raw)
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY, strict=True)],
                                      schema=_ENTRY)
        if out is not None:
            out.close()
    return run


def _indexer(folder: str, block: int, level: int):
    schema = pa.schema([("first", pa.binary()), ("file", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        out, name, directory, at, lines = None, "", [], 0, []

        def flush() -> None:
            nonlocal out, name, at
            if out is None:
                store.create_dir(root, recursive=True)
                name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.cdx.gz"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            raw = gzip.compress(json.dumps(lines).encode(), level, mtime=0)
            out.write(raw)
            directory.append((lines[0][0], at, len(raw)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append((key.decode("utf-8"), file, offset, length))
                if len(lines) >= block:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write(json.dumps(directory).encode())
            yield pa.record_batch([pa.array([directory[0][0].encode()], pa.binary()), pa.array([name])], schema=schema)

    return run, "first binary, file string"


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100,
            block: int = 3000, index_files: int | None = None, date: str = "1970-01-01T00:00:00Z",
            roll: int = 1 << 30, level: int = 4) -> Archive:
    """Write one record per row of ``pages`` and the index; returns the archive."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    p = rows_named(pages, page_id, url, html)
    body = text_of(p, html)
    p = p.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                 F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"),
                 body.cast("binary").alias("html"))
    # Only payloads that more than one page has; a table of its own, so that the join can split a hot one.
    shared = written(p.where(F.col("size") >= least).groupBy("digest")
                     .agg(F.min("page").alias("low"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1 and low is not null").select("digest", "low"), "warc-shared")
    refers = F.when((F.col("size") >= least) & ~F.col("page").eqNullSafe(F.col("low")), F.col("low"))
    marked = p.join(shared, "digest", "left").withColumn("refers_to", refers)
    marked = marked.select(
        "page", "url", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("kind"), "refers_to",
        "size", "digest", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))
    entries = written(marked.mapInArrow(_writer(folder, date, roll, level), _ENTRY_SQL), "warc-entries")
    n, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    run, schema = _indexer(folder, block, level)
    # The number of files follows the records; a number that is given is left alone by adaptive execution.
    files = index_files or max(spark.sparkContext.defaultParallelism, -(-n // _LINES_PER_FILE))
    top = sorted((bytes(r.first), r.file) for r in entries.repartitionByRange(files, "key")
                 .sortWithinPartitions("key", "file", "offset").mapInArrow(run, schema).collect())  # one row a file
    return Archive(folder, [k for k, _ in top], [f for _, f in top], n, size)


def _assigned(arch: Archive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sort_key(u, p) for p, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            at = [bisect.bisect_right(arch.first_keys, k) - 1 for k in keys]
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(keys, pa.binary())], names=["cdx", "key"])
    return run


def _found(arch: Archive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(arch.folder)
        open_file, source, directory, firsts = -1, None, [], []
        block_at, block, keys = -1, [], []
        for batch in batches:
            rows = []
            for cdx, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cdx < 0:
                    continue
                if cdx != open_file:
                    name = f"{root}/{arch.index_files[cdx]}"
                    with store.open_input_file(f"{name}.dir") as d:
                        directory = json.loads(d.read())
                    firsts = [x[0].encode() for x in directory]
                    source, open_file, block_at = store.open_input_file(name), cdx, -1
                b = max(bisect.bisect_left(firsts, key) - 1, 0)
                while b < len(directory) and firsts[b] <= key:
                    if b != block_at:
                        _, offset, length = directory[b]
                        block = json.loads(gzip.decompress(source.read_at(length, offset)))
                        keys, block_at = [x[0].encode() for x in block], b
                    for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                        rows.append((key, *block[i][1:]))
                    b += 1
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY, strict=True)],
                                      schema=_ENTRY)
    return run


def _reader(folder: str, keep_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, source = file, store.open_input_file(f"{root}/{file}")
                fields, payload = parsed(zlib.decompress(source.read_at(length, offset), 31))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(fields["X-Payload-Length"])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind,
                             _page(fields.get("WARC-Refers-To")),
                             payload if keep_payload and kind == "response" else None))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)

    return run, ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, payload binary")


def lookup(spark: SparkSession, arch: Archive, wanted: DataFrame, page_id: str = "page_id", url: str = "url",
           keep_payload: bool = True, stripe: int | None = None, per_task: int = 64 << 20) -> DataFrame:
    """The records of the wanted (page id, url) pairs, read from the archive by range.

    Index lines are dealt out by key range and records by stripes of their files, to numbers of tasks that follow
    the archive's lines and bytes (about ``per_task`` bytes a task, and all cores at least): the places that are
    shuffled say nothing of the bytes behind them.
    """
    cores = spark.sparkContext.defaultParallelism
    lookups = max(cores, -(-arch.n_records // _LINES_PER_TASK))
    readers = max(cores, -(-arch.n_bytes // per_task))
    stripe = stripe or max(1, min(per_task // 4, -(-arch.n_bytes // (4 * readers))))
    w = rows_named(wanted, page_id, url).select(F.col(page_id).cast("long"), F.col(url).cast("string")).distinct()
    run, schema = _reader(arch.folder, keep_payload)
    places = (w.mapInArrow(_assigned(arch), "cdx int, key binary").distinct()
              .repartitionByRange(lookups, "cdx", "key").sortWithinPartitions("cdx", "key")
              .mapInArrow(_found(arch), _ENTRY_SQL))
    return (places.select("file", "offset", "length", F.floor(F.col("offset") / stripe).alias("stripe"))
            .repartition(readers, "file", "stripe").sortWithinPartitions("file", "offset").select("file", "offset", "length")
            .mapInArrow(run, schema))
