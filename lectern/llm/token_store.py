"""Token ids of documents as files of bit planes: blocks of ids transposed, each plane compressed, with an index of blocks and documents."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.packing import _NO_BLANKS, _UNUSUAL, _byte_letters
from lectern.llm.shared import in_small_batches, partitions_for, scratch_path, worker_cache, written
from lectern.llm.warc_store import _filesystem

_MAGIC = b"LTOKENS1"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@dataclass(frozen=True)
class TokenConfig:
    """tokenizer: path of a tokenizers file that every executor has, of any layout. end_id: follows each document.

    block: ids of a block. planes: "bit" or "byte". level: of zstandard. file_ids: a file is closed after the document that
    fills it. cached_words: parts of texts in each half of a worker's cache. read_ids: ids that a reading task gets at most.
    """

    tokenizer: str
    end_id: int = 0
    block: int = 1 << 16
    planes: str = "bit"
    level: int = 3
    file_ids: int = 64 << 20
    cached_words: int = 500_000
    read_ids: int = 64 << 20


class _Ids(dict):
    """piece of text -> its ids as bytes. When limit pieces are held they become the older half, from which those met again move back."""

    def __init__(self, limit: int, encode: Callable[[str], bytes]):
        super().__init__()
        self.limit, self.encode, self.older = limit, encode, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        known = self.older.get(piece)
        self[piece] = known = self.encode(piece) if known is None else known
        return known

    def all(self, pieces: list[str]) -> bytes:
        found, at = list(map(self.get, pieces)), -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self[pieces[at]]
        return b"".join(found)


def _classes() -> tuple[str, str]:
    """Letters and numbers among the common characters, as the inside of a class of a regular expression."""
    common = [chr(c) for c in range(0x370)]
    return tuple("".join(re.escape(c) for c in common if unicodedata.category(c)[0] == kind) for kind in "LN")


_L, _N = _classes()


class ByteLevelEncoder:
    """The tokenizer's ids as little-endian 32-bit numbers. Under the byte-level layout the parts of texts are remembered.

    A text of common characters falls into the layout's parts, which the tokenizer's model encodes. In any other, runs of
    blanks with the word behind them are apart from each other; those with other characters, or with the sign that begins a
    special token, are the whole tokenizer's. Other layouts encode whole texts.
    """

    #: Fixed value: how the byte-level layout parts a text (letters first, which no earlier choice could take).
    _PARTS = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
    _RUNS = re.compile(r"\s*\S+|\s+")

    def __init__(self, path: str, cached_words: int):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        state = lambda x: None if x is None else json.loads(x.__getstate__())
        own = all(t.content.startswith("<|") and " " not in t.content and not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in self.whole.get_added_tokens_decoder().values())
        plain = self.whole.truncation is None and self.whole.padding is None and self.whole.post_processor is None
        self.by_part = own and plain and self.whole.normalizer is None and state(self.whole.pre_tokenizer) == _BYTE_LEVEL
        self.model, self.letters = self.whole.model, _byte_letters()
        self.parts, self.runs = _Ids(cached_words, self._part), _Ids(cached_words // 8, self._run)

    def _part(self, part: str) -> bytes:
        spelled = part if part.isalpha() and part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _common(self, text: str) -> bool:
        return "<|" not in text and (text.isascii() or not _UNUSUAL.search(text))

    def _run(self, text: str) -> bytes:
        return self.parts.all(self._PARTS.findall(text)) if self._common(text) else self._encoded(text)

    def _encoded(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_part or any(c in text for c in _NO_BLANKS):
            return self._encoded(text)
        return self._run(text) if self._common(text) else self.runs.all(self._RUNS.findall(text))


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first; those above its largest id are left out."""
    octets = -(-int(ids.max()).bit_length() // 8) if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, :octets]
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(octets)]
    bits = np.ascontiguousarray(np.unpackbits(raw, axis=1, bitorder="little").T)
    return [np.packbits(b).tobytes() for b in bits[: int(ids.max()).bit_length() if len(ids) else 0]]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The block of n ids whose planes these are."""
    out = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
    elif planes:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.view("<u4").ravel()


class TokenWriter:
    """A file: the blocks' planes, then the index (JSON line, place of each plane, length of each document), its length and a mark."""

    def __init__(self, stream, cfg: TokenConfig):
        self.stream, self.cfg, self.zip = stream, cfg, zstandard.ZstdCompressor(level=cfg.level)
        self.waiting, self.n_waiting, self.at, self.ids = [], 0, 0, 0
        self.sizes: list[list[int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.cfg.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        held, size = np.frombuffer(b"".join(self.waiting), "<u4"), self.cfg.block
        for k in range(0, len(held) if last else len(held) - size + 1, size):
            planes = [self.zip.compress(p) for p in planes_of(held[k : k + size], self.cfg.planes)]
            self.stream.write(b"".join(planes))
            self.sizes.append([len(p) for p in planes])
        rest = held[len(held) - len(held) % size :] if not last else held[:0]
        self.waiting, self.n_waiting = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(True)
        planes = np.array([s + [0] * (32 - len(s)) for s in self.sizes], "<u4").reshape(-1, 32)
        ids = np.array([0 if d is None else d for d in self.docs], "<i8")
        head = {"block": self.cfg.block, "planes": self.cfg.planes, "blocks": len(self.sizes), "docs": len(self.docs), "ids": self.ids}
        body = json.dumps(head).encode() + b"\n" + planes.tobytes() + ids.tobytes() + np.array([d is None for d in self.docs], np.uint8).tobytes() + np.array(self.lengths, "<i8").tobytes()
        index = self.zip.compress(body)
        self.stream.write(index + len(index).to_bytes(8, "little") + _MAGIC)
        self.stream.close()


class TokenFile:
    """Reads a file by its index: any range of ids costs the blocks that it touches."""

    def __init__(self, store, path: str):
        self.source = store.open_input_file(path)
        size = self.source.size()
        tail = self.source.read_at(16, size - 16) if size >= 16 else b""
        if tail[8:] != _MAGIC:
            raise ValueError(f"{path} is no whole file of tokens")
        length = int.from_bytes(tail[:8], "little")
        body = zstandard.ZstdDecompressor().decompress(self.source.read_at(length, size - 16 - length))
        head, _, rest = body.partition(b"\n")
        self.head = json.loads(head)
        self.block, self.kind, self.n = self.head["block"], self.head["planes"], self.head["ids"]
        blocks, docs = self.head["blocks"], self.head["docs"]
        self.sizes = np.frombuffer(rest, "<u4", blocks * 32).reshape(-1, 32)
        ids = np.frombuffer(rest, "<i8", docs, blocks * 128).tolist()
        null = np.frombuffer(rest, np.uint8, docs, blocks * 128 + docs * 8).tolist()
        self.docs = [None if none else d for d, none in zip(ids, null)]
        self.lengths = np.frombuffer(rest, "<i8", docs, blocks * 128 + docs * 9)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.places = np.concatenate(([0], np.cumsum(self.sizes.sum(axis=1, dtype=np.int64))))
        self.unzip = zstandard.ZstdDecompressor()

    def ids_of_block(self, k: int) -> np.ndarray:
        raw, at, planes = self.source.read_at(int(self.places[k + 1] - self.places[k]), int(self.places[k])), 0, []
        for size in self.sizes[k][self.sizes[k] > 0].tolist():
            planes.append(self.unzip.decompress(raw[at : at + size]))
            at += size
        return ids_of(planes, min(self.block, self.n - k * self.block), self.kind)

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids from start on, n of them, block by block."""
        for k in range(start // self.block, -(-(start + n) // self.block)):
            lo, hi = max(0, start - k * self.block), min(self.block, start + n - k * self.block)
            yield self.ids_of_block(k)[lo:hi]

    def ids(self, start: int, n: int) -> np.ndarray:
        return np.concatenate([*self.parts(start, n), np.zeros(0, "<u4")])

    def document_at(self, position: int) -> int:
        """Which of the file's documents an id belongs to: binary search in the documents' starts."""
        return bisect_right(self.starts, position) - 1


_FILE = "file string, first_id long, first_row long, ids long, docs long"


def write_tokens(docs: DataFrame, folder: str, cfg: TokenConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs in the order of their ids into files of a folder; returns their list (file, first_id, start, ids, docs).

    Rows are dealt by range of id, so files follow each other, and start, the ids before a file, is a sum over the list: a
    row for each file, of 64 million ids. Rows with one id, and null ids, which come first, are in the order in which they are
    read and can be spread over tasks. A file is named in the list once its task is done; one that a lost task left is not.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = in_small_batches(rows).repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    end = cfg.end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        encoder = worker_cache(f"byte tokens {cfg.tokenizer} {cfg.cached_words}", lambda: ByteLevelEncoder(cfg.tokenizer, cfg.cached_words))
        out, rows = None, []

        def closed() -> None:
            out.close()
            rows.append((name, *first, out.ids, len(out.docs)))

        for batch in batches:
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                if out is None:
                    name, first = f"{uuid.uuid4().hex}.tokens", (doc, row)
                    out = TokenWriter(store.open_output_stream(f"{root}/{name}"), cfg)
                out.add(doc, encoder.ids(text or "") + end)
                if out.ids >= cfg.file_ids:
                    closed()
                    out = None
        if out is not None:
            closed()
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _FILE.split(", ")])

    files = written(dealt.select("doc_id", "row", "text").mapInArrow(run, _FILE), "token_files")
    before = W.orderBy(F.asc_nulls_first("first_id"), "first_row").rowsBetween(W.unboundedPreceding, -1)
    return written(files.select("file", "first_id", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "ids", "docs"), "token_list")


def read_documents(files: DataFrame, folder: str, cfg: TokenConfig, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; with ids also them, as little-endian 32-bit numbers."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, rows, held = TokenFile(store, f"{root}/{name}"), [], 0
                parts, now, used = file.parts(0, file.n), np.zeros(0, "<u4"), 0
                for doc, at, n in zip(file.docs, file.starts.tolist(), file.lengths.tolist()):
                    crc, left, own = 0, n, []
                    while left:
                        if used == len(now):
                            now, used = next(parts), 0
                        piece = now[used : used + left].tobytes()
                        crc, used, left = zlib.crc32(piece, crc), used + len(piece) // 4, left - len(piece) // 4
                        if ids:
                            own.append(piece)
                    rows.append((doc, start + at, n, crc, b"".join(own))[: len(names)])
                    held += n if ids else 1
                    if len(rows) == 4096 or held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    total = files.agg(F.sum("ids")).first()[0] or 0
    tasks = partitions_for(files.sparkSession, total, 1 << 20, cfg.read_ids)
    return files.select("file", "start").repartitionByRange(tasks, "start").mapInArrow(run, schema)


def round_trip(docs: DataFrame, cfg: TokenConfig, folder: str | None = None) -> DataFrame:
    """Write docs as files of tokens and read every document back: (doc_id, start, n_tokens, ids_crc32).

    Defined cases: null or empty text is the end id alone; null ids come first; rows with one id, also repeated rows, are
    documents of their own, one after the other; a text longer than a block spans blocks, and lies in one file; other columns
    are ignored; an empty table gives no files and no rows.
    """
    root = folder or scratch_path(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, root, cfg), root, cfg)
