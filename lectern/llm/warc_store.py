"""WARC archives with a two-level capture index: sorted blocks of keys, and a sparse directory of the blocks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.shared import in_small_batches, partitions_for, scratch_path, written

_CRLF = b"\r\n"
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class WarcConfig:
    """file_bytes: an archive is closed once it is that large. block_lines: captures in an index block. level: of gzip.

    open_files: archives and blocks that a lookup task keeps open at a time. date: of the records, as the standard writes
    it; by default the time at which writing begins. read_bytes: of archives that a lookup task reads at most.
    """

    file_bytes: int = 256 << 20
    block_lines: int = 512
    level: int = 4
    open_files: int = 8
    date: str | None = None
    read_bytes: int = 64 << 20


def surt(url: Column) -> Column:
    """Sort key of a URL: the host's labels from last to first, then port, path and query. A null or odd URL is its own key."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)(:\d+)?(.*)$"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_extract(url, pattern, 2), F.lit(")"), F.regexp_extract(url, pattern, 3))
    return F.when(host == "", url).otherwise(key)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path in the shared folder: a URI of any store that pyarrow knows, or a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Original:
    """The response that a revisit refers to."""

    page_id: int
    url: str | None


def _uri(url: str | None) -> bytes:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()


def record(record_id: uuid.UUID, date: str, page_id: int | None, url: str | None, payload: bytes, original: Original | None) -> bytes:
    """One WARC/1.1 record. A revisit holds no payload, but its digest, its length and the response it refers to.

    X-Page-Id and X-Refers-To-Page-Id are fields of our own: ids of pages may repeat, those of records don't.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if original is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if original is not None else b"response")]
    head += [b"WARC-Record-ID: <urn:uuid:%s>" % str(record_id).encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + _uri(url)]
    head.append(b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode())
    if original is not None:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [b"WARC-Refers-To-Target-URI: " + _uri(original.url), b"WARC-Refers-To-Date: " + date.encode(), b"X-Refers-To-Page-Id: %d" % original.page_id]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return _CRLF.join(head) + _CRLF * 2 + body + _CRLF * 2


def parse(raw: bytes) -> dict:
    """Type, page, URL, payload (None for a revisit), the payload's full length and digest, and the page a revisit refers to."""
    head, _, rest = raw.partition(_CRLF * 2)
    fields = dict(line.split(b": ", 1) for line in head.split(_CRLF)[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(_CRLF * 2)
    length = int(dict(line.split(b": ", 1) for line in http.split(_CRLF)[1:])[b"Content-Length"])
    kind, page = fields[b"WARC-Type"].decode(), fields.get(b"X-Page-Id")
    found = {"type": kind, "page_id": None if page is None else int(page), "url": fields[b"WARC-Target-URI"].decode(), "bytes": length}
    if kind == "revisit":
        return found | {"payload": None, "digest": fields[b"WARC-Payload-Digest"][5:].decode(), "refers_to": int(fields[b"X-Refers-To-Page-Id"])}
    if len(payload) != length:
        raise ValueError(f"record of page {page!r} is damaged: {len(payload)} of {length} bytes")
    return found | {"payload": payload, "digest": base32_sha1(payload), "refers_to": None}


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to and refers_url: the smallest page_id of an equal payload of least_bytes or
    more, if another page's, and its URL (the smallest of several).

    Payloads are compared by SHA-256. The join on the digest is one that adaptive execution can split, so a payload
    of a third of all pages is no hot task.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    keyed = keyed.withColumn("sha", F.unhex(F.sha2(F.col("html"), 256)))
    known = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    heads = keyed.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(known.alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("sha", "first")
    joined = keyed.join(heads, "sha", "left")
    refers = F.when(~F.col("first.page_id").eqNullSafe(F.col("page_id")), F.col("first.page_id"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"), F.col("first.url").alias("refers_url"))


def write_archives(pages: DataFrame, folder: str, cfg: WarcConfig = WarcConfig(), least_bytes: int = 0) -> DataFrame:
    """Write a WARC record for each row of pages; returns the captures (key, page_id, file, at, length).

    Each record is a gzip member of its own; its id is made of its file and place. A task's files bear a name of their own, and only those of the
    attempt that Spark commits are named in the captures, so a lost executor leaves no half archive in use.
    """

    date = cfg.date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name = None, ""
        try:
            for batch in batches:
                rows = []
                for key, page, url, html, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or out.tell() >= cfg.file_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    original = None if refers is None else Original(refers, refers_url)
                    member = gzip.compress(record(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{out.tell()}"), date, page, url, (html or "").encode(), original), cfg.level, mtime=0)
                    rows.append((key, page, name, out.tell(), len(member)))
                    out.write(member)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, ["key", "page_id", "file", "at", "length"])
        finally:
            if out is not None:
                out.close()

    records = with_originals(pages, least_bytes).select(surt(F.col("url")).alias("key"), "page_id", "url", "html", "refers_to", "refers_url")
    return written(in_small_batches(records).mapInArrow(run, "key string, page_id long, file string, at long, length long"), "captures")


def build_index(captures: DataFrame, folder: str, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Write the captures, sorted by key, as compressed blocks; returns the directory's parts (first, file), one for each index file.

    Level one: blocks of block_lines captures, each compressed by itself. Level two, at the end of each index file:
    the first key, place and length of every block. Keys are dealt by range, with the page's id in the key, so that
    a host or URL with very many captures spreads over files.
    """
    ordered = captures.withColumn("page_key", F.coalesce("page_id", F.lit(_NO_ID)))
    ordered = ordered.repartitionByRange("key", "page_key", "file", "at").sortWithinPartitions("key", "page_key", "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, directory, lines, place = f"{uuid.uuid4().hex}.idx", [], [], 0
        out = None

        def flush() -> None:
            nonlocal place
            block = zlib.compress(json.dumps(lines, separators=(",", ":")).encode(), cfg.level)
            directory.append([lines[0][0], lines[0][1], place, len(block)])
            out.write(block)
            place += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(list(row))
                if len(lines) == cfg.block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        tail = zlib.compress(json.dumps(directory, separators=(",", ":")).encode(), cfg.level)
        out.write(tail + len(tail).to_bytes(8, "little"))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name])], ["key", "page_key", "file"])

    rows = ordered.select("key", "page_key", "file", "at", "length").mapInArrow(run, "key string, page_key long, file string")
    return written(rows, "directory")


class _Reader:
    """Range reads of one folder's files, with a bounded number of files and index blocks kept."""

    def __init__(self, folder: str, cfg: WarcConfig):
        self.fs, self.root = _filesystem(folder)
        self.cfg, self.files, self.parts, self.blocks = cfg, OrderedDict(), OrderedDict(), OrderedDict()

    def _kept(self, store: OrderedDict, key, make):
        if key in store:
            store.move_to_end(key)
            return store[key]
        while len(store) >= self.cfg.open_files:
            old = store.popitem(last=False)[1]
            if hasattr(old, "close"):
                old.close()
        store[key] = made = make()
        return made

    def bytes(self, file: str, at: int, length: int) -> bytes:
        source = self._kept(self.files, file, lambda: self.fs.open_input_file(f"{self.root}/{file}"))
        return source.read_at(length, at)

    def directory(self, file: str) -> list:
        def load() -> list:
            size = self._kept(self.files, file, lambda: self.fs.open_input_file(f"{self.root}/{file}")).size()
            length = int.from_bytes(self.bytes(file, size - 8, 8), "little")
            return json.loads(zlib.decompress(self.bytes(file, size - 8 - length, length)))

        return self._kept(self.parts, file, load)

    def block(self, file: str, at: int, length: int) -> list:
        return self._kept(self.blocks, (file, at), lambda: json.loads(zlib.decompress(self.bytes(file, at, length))))


def _captures(reader: _Reader, parts: list, key: str, page: int) -> Iterator[list]:
    """The captures of a key and page: binary search in the list of files, in a file's directory, and in a block."""
    wanted = (key.encode(), page)
    order = lambda row: (row[0].encode(), row[1])
    k = max(0, bisect_left(parts, wanted, key=order) - 1)
    while k < len(parts) and order(parts[k]) <= wanted:
        directory = reader.directory(parts[k][2])
        b = max(0, bisect_left(directory, wanted, key=order) - 1)
        while b < len(directory) and order(directory[b]) <= wanted:
            lines = reader.block(parts[k][2], *directory[b][2:])
            yield from lines[bisect_left(lines, wanted, key=order) : bisect_right(lines, wanted, key=order)]
            b += 1
        k += 1


def located(queries: DataFrame, directory: DataFrame, index: str, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """(file, at, length): the captures that queries (key, page_id) name, found by binary search in the index.

    Queries are sorted and dealt by range, so that a task meets a block once. The list of index files goes to every task; it
    has a row for each partition of the index, so the number of shuffle partitions bounds it.
    """
    parts = sorted(map(tuple, directory.select("key", "page_key", "file").collect()), key=lambda r: (r[0].encode(), r[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Reader(index, cfg)
        for batch in batches:
            rows = [found[2:] for key, page in zip(*(c.to_pylist() for c in batch.columns)) for found in _captures(blocks, parts, key, page)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["file", "at", "length"])

    wanted = queries.select(F.coalesce("key", F.lit("")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page_id")).distinct()
    tasks = partitions_for(queries.sparkSession, queries.count(), 2_000, 200_000)
    return wanted.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, "file string, at long, length long")


def lookup(queries: DataFrame, directory: DataFrame, archives: str, index: str, cfg: WarcConfig = WarcConfig(), payloads: bool = False) -> DataFrame:
    """The records of the captures that queries (key, page_id) name: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    payloads adds the payload of responses. What the index says is dealt by archive and place, into tasks by the bytes
    that they read, so that each archive is read in order.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    if payloads:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"
    found = written(located(queries, directory, index, cfg), "located")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, rows = _Reader(archives, cfg), []
        for batch in batches:
            for file, at, length in zip(*(c.to_pylist() for c in batch.columns)):
                r = parse(gzip.decompress(files.bytes(file, at, length)))
                rows.append((r["page_id"], r["url"], r["type"], r["bytes"], r["digest"], r["refers_to"], r["payload"])[: len(names)])
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    tasks = partitions_for(queries.sparkSession, found.agg(F.sum("length")).first()[0] or 0, 1 << 20, cfg.read_bytes)
    return found.repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at").mapInArrow(run, schema)


def round_trip(pages: DataFrame, cfg: WarcConfig = WarcConfig(), least_bytes: int = 0, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write pages (page_id, url, html) as archives with their index, then find and read every page's records back.

    Defined cases: null html is an empty payload; a null or odd url is its own key; a null page_id is written and found
    like any other, and is never what a revisit refers to; rows with the same page_id and payload are all responses
    or all revisits of the same page, and each comes back; each payload of a page with several is judged by itself; other columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    root = folder or scratch_path(spark, "warc")
    captures = write_archives(pages, f"{root}/archives", cfg, least_bytes)
    directory = build_index(captures, f"{root}/index", cfg)
    return lookup(captures.select("key", "page_id"), directory, f"{root}/archives", f"{root}/index", cfg, payloads)
