"""Documents packed into token windows of one length: bounded-space best fit in each partition, then merged leftovers."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import in_small_batches, worker_cache, written


@dataclass(frozen=True)
class PackingConfig:
    """tokenizer: path of a tokenizers file that every executor has, of any layout. end_id: follows each document.

    open_windows: windows that a partition keeps open. merged: partitions whose leftovers one task merges in a round.
    """

    tokenizer: str
    length: int = 2048
    end_id: int = 1
    open_windows: int = 16
    merged: int = 64
    #: Words of each half of a worker's cache, which bounds its memory.
    cached_words: int = 500_000


#: How a word_bpe vocabulary normalises and parts a text. Words are remembered only under this layout.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PARTS = regex.compile(_SPLIT)
#: Words with other characters are left to the tokenizer, like those with the sign that begins a special token.
_UNUSUAL = re.compile("[^\\x00-\\u036f\\u2010-\\u2027\\u20ac]")
#: Python parts words at these, the tokenizer does not.
_NO_BLANKS = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class _Words(dict):
    """word between blanks -> its ids as little-endian bytes; a word that lacks is noted in asked and gives nothing.

    When limit words are held, they become the older half, from which those that are met again move back.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older, self.asked = limit, {}, []

    def __missing__(self, word: str) -> bytes:
        if (known := self.older.get(word)) is None:
            self.asked.append(word)
            return b""
        self[word] = known
        return known

    def age(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()


def _parts_at_blanks(tokenizer) -> bool:
    """Whether this tokenizer has the layout in which white space parts words and no merge crosses it."""
    state = lambda x: None if x is None else json.loads(x.__getstate__())
    own = all(t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word) for t in tokenizer.get_added_tokens_decoder().values())
    plain = tokenizer.truncation is None and tokenizer.padding is None and tokenizer.post_processor is None
    return own and plain and state(tokenizer.normalizer) == _NORMALIZER and state(tokenizer.pre_tokenizer) == _PRE_TOKENIZER


class TextEncoder:
    """The tokenizer's ids. Under the layout of word_bpe, words seen before are remembered; any other one encodes whole texts."""

    def __init__(self, path: str, cached_words: int):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.by_word = _parts_at_blanks(self.whole)
        self.model, self.words, self.parts, self.letters = self.whole.model, _Words(cached_words), _Words(cached_words // 4), _byte_letters()

    def _part(self, part: str) -> bytes:
        if not (known := self.parts[part]):
            # printable ASCII stands for itself; every other byte, control characters among them, has a letter of its own
            spelled = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
            known = self.parts[part] = _bytes([t.id for t in self.model.tokenize(spelled)])
        return known

    def _word(self, word: str) -> bytes:
        if "<|" in word or not word.isascii() and _UNUSUAL.search(word):
            return _bytes(self.whole.encode(word, add_special_tokens=False).ids)
        low = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
        if low.isalpha():
            return self._part(low)
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return self._part(low[:-1]) + self._part(low[-1])
        return b"".join(map(self._part, _PARTS.findall(low)))

    def ids(self, text: str) -> bytes:
        if not self.by_word or any(c in text for c in _NO_BLANKS):
            return _bytes(self.whole.encode(text, add_special_tokens=False).ids)
        words, known = text.split(), self.words
        known.age()
        self.parts.age()
        self.parts.asked.clear()
        found = list(map(known.__getitem__, words))
        if known.asked:
            for word in set(known.asked):
                known[word] = self._word(word)
            known.asked.clear()
            found = map(known.__getitem__, words)
        return b"".join(found)


class Packer:
    """Online packing with a fixed number of open windows. A piece is (doc_id, start, ids as bytes, doc_tokens).

    A piece goes to the open window with the smallest gap that holds it, or to a new window if fewer than open_windows
    are open. If none fits, the fullest window takes as much of the piece as its gap holds and is emitted full.
    """

    def __init__(self, length: int, open_windows: int, first_id: int):
        self.length, self.limit, self.next_id = length, open_windows, first_id
        self.open: list[tuple[int, list]] = []
        self.done: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        at, left = 0, len(ids) // 4
        while left:
            piece = lambda n: (doc, start + at, ids[4 * at : 4 * (at + n)], total)  # noqa: B023, E731
            if left >= self.length:
                self._emit([piece(self.length)])
                at, left = at + self.length, left - self.length
                continue
            fits = [(self.length - fill, k) for k, (fill, _) in enumerate(self.open) if self.length - fill >= left]
            if fits:
                gap, k = min(fits)
                fill, pieces = self.open[k]
                pieces.append(piece(left))
                if gap == left:
                    self.open.pop(k)
                    self._emit(pieces)
                else:
                    self.open[k] = (fill + left, pieces)
                return
            if len(self.open) < self.limit:
                self.open.append((left, [piece(left)]))
                return
            fill, k = max((fill, -k) for k, (fill, _) in enumerate(self.open))
            pieces = self.open.pop(-k)[1]
            cut = self.length - fill
            pieces.append(piece(cut))
            self._emit(pieces)
            at, left = at + cut, left - cut

    def close(self) -> None:
        """Leftovers as one run of tokens, cut at the window's length, and its rest into powers of two: nothing is padded."""
        pieces = [p for _, window in self.open for p in window]
        self.open = []
        total = sum(len(p[2]) // 4 for p in pieces)
        room, window = 0, []
        for doc, start, ids, tokens in pieces:
            at = 0
            while at < len(ids) // 4:
                room = room or min(self.length, 1 << (total.bit_length() - 1))
                n = min(room, len(ids) // 4 - at)
                window.append((doc, start + at, ids[4 * at : 4 * (at + n)], tokens))
                at, room, total = at + n, room - n, total - n
                if not room:
                    self._emit(window)
                    window = []


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"
_KINDS = [*[pa.int64()] * 7, pa.int32(), pa.binary()]
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)


def _flushed(packer: Packer, part: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Finished pieces, and with last the open windows, as rows with the part they lie in."""
    for k in range(0, len(packer.done), 4096):
        yield _batch([(*p, part, None) for p in packer.done[k : k + 4096]])
    packer.done = []
    if last:
        rows = [(doc, start, len(ids) // 4, None, total, None, None, part, ids) for _, window in packer.open for doc, start, ids, total in window]
        if rows:
            yield _batch(rows)


def pack(docs: DataFrame, cfg: PackingConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of docs.

    Documents are tokenized and packed where they are read, without a shuffle. Each partition leaves at most
    open_windows windows; these are merged by the same rules in rounds, `merged` partitions at a time, so that no task
    gathers what grows with the input. The last round cuts what is left into windows and powers of two.

    Defined cases: null or empty text is the end id alone; a null id is carried; repeated rows are packed one by one;
    other columns are ignored; an empty table gives no pieces.
    """
    texts = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = cfg.end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), worker_cache(f"tokenizer {cfg.tokenizer} {cfg.cached_words}", lambda: TextEncoder(cfg.tokenizer, cfg.cached_words))
        packer = Packer(cfg.length, cfg.open_windows, part << 24)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                packer.add(doc, 0, ids, len(ids) // 4)
            yield from _flushed(packer, part, False)
        yield from _flushed(packer, part, True)

    rounds = [written(texts.mapInArrow(first, _SCHEMA), "packed")]
    while True:
        left = rounds[-1].where("ids is not null")
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        final, base = most < cfg.merged, len(rounds) << 56

        def merge(batches: Iterator[pa.RecordBatch], final: bool = final, base: int = base) -> Iterator[pa.RecordBatch]:
            now, packer = None, None
            for batch in batches:
                for part, doc, start, total, ids in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    if part != now:
                        if packer:
                            yield from _flushed(packer, now, True)
                        now, packer = part, Packer(cfg.length, cfg.open_windows, base | part << 24)
                    packer.add(doc, start, ids, total)
            if packer:
                if final:
                    packer.close()
                yield from _flushed(packer, now, True)

        group = F.floor(F.col("part") / cfg.merged).cast("int")
        dealt = left.select(group.alias("part"), "doc_id", "start", "doc_tokens", "ids").repartition("part").sortWithinPartitions("part", "doc_id", "start")
        rounds.append(written(dealt.mapInArrow(merge, _SCHEMA), "packed"))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.where("ids is null").drop("part", "ids")
