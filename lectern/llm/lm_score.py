"""Stupid-backoff scores: n-gram count tables of the whole corpus, partitioned by hash and joined to the n-grams of its documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import LOWER_AZ, discard, grouped, in_small_batches, mix64, odd_constants, released, scratch_path, written


@dataclass(frozen=True)
class BackoffConfig:
    """alpha: weight of each level down. order: words of the longest n-gram, 1 or more. unseen: count of a word that no other
    document has. chunk_words: words of some documents that a task turns into n-grams at a time, which bounds its memory.
    """

    alpha: float = 0.4
    unseen: float = 0.5
    order: int = 3
    chunk_words: int = 2_200_000


def _zipped(x: np.ndarray) -> bytes:
    """Byte planes of integers, compressed: small and frequent numbers cost little."""
    return pa.compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unzipped(raw: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 256


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, one text after the other, and how many words each text has.

    All words are hashed together, eight bytes at a time; those of over _LONG bytes one by one.
    """
    lists = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    raw = (b" " + b" ".join(lists) + b" " * 8).translate(LOWER_AZ)
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight, c = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)), odd_constants(3, 37)
    out = mix64((eight[starts] & _FIRST[np.minimum(size, 8)]) * c[0] + size.astype(np.uint64) * c[1])
    left, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(left):
        out[left] = mix64(out[left] * c[2] + (eight[starts[left] + done] & _FIRST[np.minimum(size[left] - done, 8)]))
        done += 8
        left = left[size[left] > done]
    for k in np.flatnonzero(size > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + size[k]])
    ends = np.cumsum(np.array([len(t) + 1 for t in lists], np.int64))
    return out, np.diff(np.searchsorted(starts, ends, "right"), prepend=0)


class Chunk:
    """Some documents: ids, numbers of words, the hash of each distinct word (most frequent first), and each word's place in that list."""

    def __init__(self, docs: list, lengths: np.ndarray, vocabulary: np.ndarray, tokens: np.ndarray):
        self.docs, self.lengths, self.vocabulary, self.tokens = docs, lengths, vocabulary, tokens
        self.doc = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)

    @classmethod
    def of(cls, docs: list, words: list[np.ndarray]) -> Chunk:
        every, place, counts = _ranked(np.concatenate(words))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(every), np.uint32)
        rank[order] = np.arange(len(every), dtype=np.uint32)
        return cls(docs, np.array([len(w) for w in words], np.int64), every[order], rank[place])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n-grams of one word, by rank: the sorted keys, which of them each place has, and how often each stands in the chunk."""
        c = odd_constants(4, 31)
        keys = mix64(self.vocabulary * c[0] + c[2])
        order = _order(keys)
        place = np.empty(len(keys), np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        return keys[order], place[self.tokens], np.bincount(self.tokens, minlength=len(keys))[order]

    def levels(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n from 2 to order: the places of words with n - 1 words of their document before them, and the n-gram's key at each."""
        c, doc = odd_constants(4, 31), self.doc
        hashes = self.vocabulary[self.tokens]
        last, added = hashes, c[3:]
        for n in range(2, order + 1):
            at = np.flatnonzero(doc[n - 1 :] == doc[: max(0, len(doc) - n + 1)]).astype(np.int32)
            at += n - 1
            key = last[at - 1]
            key *= c[0]
            word = hashes[at]
            word *= c[1]
            key += word
            key += added
            del word
            key = mix64(key)
            if n < order:
                last, added = np.zeros(len(doc), np.uint64), added + c[2:3]
                last[at] = key
            yield at, key


def _order(keys: np.ndarray) -> np.ndarray:
    """argsort of hashes. Their upper bits are sorted with the places in the lower ones, which takes a fraction of the time;
    different hashes with equal upper bits are few and then put in order."""
    low = np.uint64((1 << max(1, len(keys) - 1).bit_length()) - 1)
    both = np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64))
    order = (both & low).view(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong) > 1000:
        return np.argsort(keys)
    for top in np.unique(both[wrong] & ~low):
        start, end = np.searchsorted(both, top), np.searchsorted(both, top | low, "right")
        order[start:end] = order[start:end][np.argsort(found[start:end], kind="stable")]
    return order


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, which of them each place has, and how often each occurs."""
    order = _order(keys)
    sorted_ = keys[order]
    new = np.concatenate((np.ones(min(1, len(keys)), bool), sorted_[1:] != sorted_[:-1]))
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = np.flatnonzero(new)
    return sorted_[starts], which, np.diff(starts, append=len(keys))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    keys = np.sort(keys)
    return keys[np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))]


def _own(doc: np.ndarray, which: np.ndarray, size: int, step: int = 200_000) -> np.ndarray:
    """For each place, how often its n-gram stands in its document; some documents at a time, so that sorts stay small."""
    if not len(which):
        return np.zeros(0, np.int32)
    out, ends, start = np.empty(len(which), np.int32), np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)), 0
    while start < len(doc):
        end = int(ends[min(np.searchsorted(ends, start + step), len(ends) - 1)])
        _, place, counts = np.unique(doc[start:end].astype(np.int64) * size + which[start:end], return_inverse=True, return_counts=True)
        out[start:end] = counts[place]
        start = end
    return out


def _chunks(docs: DataFrame, cfg: BackoffConfig) -> DataFrame:
    """Rows of docs in chunks; part is the task, whose chunks lie in one file."""
    names = ["part", "chunk", "docs", "lengths", "vocabulary", "tokens"]
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, words, total = TaskContext.get().partitionId(), 0, [], [], 0

        def packed() -> pa.RecordBatch:
            c = Chunk.of(held, words)
            columns = [pa.array([part], pa.int32()), pa.array([part << 32 | number]), pa.array([held], lists), pa.array([c.lengths], lists), pa.array([c.vocabulary.tobytes()], pa.binary()), pa.array([_zipped(c.tokens)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            hashes, counts = hashed_words(batch.column(1))
            for doc, w in zip(batch.column(0).to_pylist(), np.split(hashes, np.cumsum(counts)[:-1])):
                if held and total + len(w) > cfg.chunk_words:
                    yield packed()
                    number, held, words, total = number + 1, [], [], 0
                held.append(doc)
                words.append(w)
                total += len(w)
        if held:
            yield packed()

    return docs.mapInArrow(run, "part int, chunk long, docs array<long>, lengths array<long>, vocabulary binary, tokens binary")


def _read_chunks(path: str) -> Iterator[tuple[int, Chunk]]:
    """(number, chunk) of a file of the chunk table, one at a time and in order."""
    path = path if "://" in path else path.removeprefix("file:")
    store, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with store.open_input_file(name) as source:
        for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
            for _, number, docs, lengths, vocabulary, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.array(lengths, np.int64)
                yield number, Chunk(docs, n, np.frombuffer(vocabulary, np.uint64), _unzipped(tokens, int(n.sum()), np.uint32))
                released()


class _Seen:
    """Which of a chunk's sorted distinct n-grams other chunks have too, and how often they have those."""

    def __init__(self, flags: np.ndarray, others: np.ndarray):
        self.flags, self.others = flags, others

    def packed(self) -> tuple[bytes, bytes, int]:
        return _zipped(np.packbits(self.flags)), _zipped(self.others), len(self.flags)

    @classmethod
    def read(cls, flags: bytes, others: bytes, size: int) -> _Seen:
        found = np.unpackbits(_unzipped(flags, (size + 7) // 8, np.uint8), count=size).astype(bool)
        return cls(found, _unzipped(others, int(found.sum()), np.int64))


_STATE = "part int, chunk long, level int, size int, flags binary, others binary"
_STATE_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _files(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(part, chunk, path): a task's file of the chunk table, with a number that comes before those of its chunks; and how many."""
    first = F.shiftleft(F.col("part").cast("long"), 32) - 1
    found = chunks.select("part", first.alias("chunk"), F.col("_metadata.file_path").alias("path")).distinct()
    return found, found.count()


def _with_files(files: tuple[DataFrame, int], rows: DataFrame | None) -> DataFrame:
    """Rows of tasks' chunks together with the tasks' files, a task's file first; each task's rows are in one partition."""
    every = files[0] if rows is None else files[0].unionByName(rows, allowMissingColumns=True)
    order = ["chunk", *(["level"] if "level" in every.columns else [])]
    rest = [c for c in every.columns if c not in ("part", "path", *order)]
    tasks = max(1, files[1])
    return every.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions(*order).select("part", "chunk", "path", *order[1:], *rest)


def _states(parts: list[pa.RecordBatch]) -> tuple[str, dict[tuple[int, int], _Seen]]:
    """The file of a task, and by chunk and level what is known of its n-grams."""
    path, found = "", {}
    for part in parts:
        for row in part.to_pylist():
            if row["path"] is not None:
                path = row["path"]
            else:
                found[row["chunk"], row["level"]] = _Seen.read(row["flags"], row["others"], row["size"])
    return path, found


def ngrams(files: tuple[DataFrame, int], states: DataFrame | None, level: int) -> DataFrame:
    """(ngram, chunk, n): how often each chunk has each of its n-grams of `level` words, which another chunk may have too.

    Another chunk can have an n-gram only if it has both n-grams that are a word shorter, so those of which it hasn't are
    left out. One row for each chunk and distinct n-gram, so a very frequent n-gram has no more rows than there are chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches, 1):
            path, known = _states(parts) if level > 1 else (parts[0].column("path")[0].as_py(), {})
            for number, chunk in _read_chunks(path):
                keys, counts = _asked(chunk, known.get((number, level - 1)), level)
                for k in range(0, len(keys), 1 << 16):
                    part = keys[k : k + (1 << 16)].view(np.int64)
                    columns = [pa.array(part), pa.array(np.full(len(part), number)), pa.array(counts[k : k + (1 << 16)].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["ngram", "chunk", "n"])

    return _with_files(files, states).mapInArrow(run, "ngram long, chunk long, n int")


def _asked(chunk: Chunk, known: _Seen | None, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's sorted distinct n-grams of a level that another chunk may have, and their counts. known: of the level below."""
    if level == 1:
        keys, _, counts = chunk.words()
        return keys, counts
    seen = np.zeros(len(chunk.tokens), bool)
    if known is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if level == 2:
        seen = known.flags[chunk.words()[1]]
    for n, (at, key) in enumerate(chunk.levels(level), 2):
        if n == level - 1:
            seen[at] = known.flags[_ranked(key)[1]]
        elif n == level:
            return np.unique(key[seen[at] & seen[at - 1]], return_counts=True)


def counted(grams: DataFrame) -> DataFrame:
    """(chunk, ngram, others): how often other chunks have a chunk's n-gram, for n-grams that several chunks have.

    Grams are joined with their count table. They are dealt by the n-gram's hash once, for the table and for the join with
    it: both read the same columns, so that Spark uses one exchange for both.
    """
    dealt = grams.repartition("ngram")
    table = dealt.groupBy("ngram").agg(F.sum("n").alias("total"), F.count("chunk").alias("chunks")).where("chunks > 1")
    return dealt.join(table.select("ngram", "total").hint("shuffle_hash"), "ngram").select("chunk", "ngram", (F.col("total") - F.col("n")).alias("others"))


#: Rows of counted that a task holds before they are put into one row for each chunk.
_HELD = 1 << 20


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of numbers, from each start to the next, as binary values."""
    offsets = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def packed(known: DataFrame) -> DataFrame:
    """The rows of counted as rows (chunk, ngrams, others) of many n-grams each, in the tasks that joined them.

    A row for each chunk and _HELD rows of a task, so that n-grams aren't written, dealt and sorted one by one again.
    """

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        chunk, grams, others = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        order = np.argsort(chunk, kind="stable")
        chunk = chunk[order]
        starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), _blobs(grams[order], starts), _blobs(others[order], starts)], ["chunk", "ngrams", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= _HELD:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return known.select("chunk", "ngram", "others").mapInArrow(run, "chunk long, ngrams binary, others binary")


def _packed_states(files: tuple[DataFrame, int], known: DataFrame, level: int) -> DataFrame:
    """The rows of packed, as a row for each chunk: a bit for each of its distinct n-grams, and the numbers of those known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = grouped(batches, 2)
        (part, number), rows = next(groups, ((None, None), []))
        while part is not None:
            path, now = rows[0].column("path")[0].as_py(), part
            (part, number), rows = next(groups, ((None, None), []))
            for k, chunk in _read_chunks(path):
                if (part, number) != (now, k):
                    continue  # nothing is known of it
                if level == 1:
                    keys = chunk.words()[0]
                else:
                    for _, key in chunk.levels(level):
                        pass
                    keys = _distinct(key)
                grams, others = (np.concatenate([np.frombuffer(x, np.int64) for r in rows for x in r.column(name).to_pylist()]) for name in ("ngrams", "others"))
                grams, flags = grams.view(np.uint64), np.zeros(len(keys), bool)
                order = _order(grams)
                flags[np.searchsorted(keys, grams[order])] = True
                flags, others, size = _Seen(flags, others[order]).packed()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, k, level, size, flags, others), _STATE_KINDS)], [c.split()[0] for c in _STATE.split(", ")])
                (part, number), rows = next(groups, ((None, None), []))

    rows = known.withColumn("part", F.shiftright("chunk", 32).cast("int"))
    return _with_files(files, rows).mapInArrow(run, _STATE)


def score(docs: DataFrame, cfg: BackoffConfig = BackoffConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_backed_off, log_score) for each row of docs, from the n-gram counts of all other rows.

    A word scores c(n-gram) / c(n-gram without the word) for the longest n-gram that it ends and another row has, of up to
    cfg.order words, times alpha for each level that the row's own words would have allowed above it; a single word scores
    c(word) / N. n_backed_off: words of which the longest such n-gram is in no other row. Counts leave the scored row out, or every n-gram would be known. log_score is the sum of natural logs.

    1. Rows are read in chunks of words, which are written with each word as its place in the chunk's vocabulary.
    2. For each n, the chunks' distinct n-grams are exploded into rows with their counts, dealt by hash, summed into the
       count table, and joined with it. An answer comes back to a chunk only for n-grams that other chunks have too; of the
       rest its own counts are all there are. The task that joined them puts a chunk's answers into one row.
    3. Answers are kept for each chunk as bits and packed numbers, and its rows are scored from them, word by word, and summed.

    The rows of every step grow with the corpus, and none of them with its square. A task holds one chunk.

    Defined cases: words are what ASCII white space parts, with A-Z lower-cased; null, empty or blank text has no words and
    log_score 0; null ids are carried; repeated rows are rows of their own; other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    texts = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = written(_chunks(texts, cfg), "chunks")
    total = chunks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    files = _files(chunks)
    states: list[DataFrame] = []
    for level in range(1, cfg.order + 1):
        path = scratch_path(spark, "known")
        known = written(packed(counted(ngrams(files, states[-1] if states else None, level))), "known", path, records=100_000, options={"compression": "zstd"})
        states.append(written(_packed_states(files, known, level), "states", records=100_000))
        discard(spark, path)
    every = states[0]
    for more in states[1:]:
        every = every.unionByName(more)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches, 1):
            path, known = _states(parts)
            for number, chunk in _read_chunks(path):
                yield _scored(chunk, [known.get((number, n)) for n in range(1, cfg.order + 1)], total, cfg)

    return _with_files(files, every).mapInArrow(finish, "doc_id long, n_words long, n_backed_off long, log_score double")


def _scored(chunk: Chunk, known: list[_Seen | None], corpus: int, cfg: BackoffConfig) -> pa.RecordBatch:
    doc, size, value, backed = chunk.doc, len(chunk.docs), np.zeros(0), np.zeros(len(chunk.doc), bool)
    distinct, which, totals = chunk.words()
    if known[0] is not None:
        totals[known[0].flags] += known[0].others
    before = (totals[which] - _own(doc, which, len(distinct))).astype(np.float64)
    value = np.log(np.maximum(before, cfg.unseen)) - np.log(np.maximum(1, corpus - chunk.lengths))[doc]
    for n, (at, key) in enumerate(chunk.levels(cfg.order), 2):
        # another row has an n-gram only if it has both that are a word shorter, so most places are settled by these
        open_ = np.flatnonzero((before[at] > 0) & (before[at - 1] > 0))
        distinct, which, totals = _ranked(key[open_])
        if (more := known[n - 1]) is not None:
            others = np.zeros(len(more.flags), np.int64)
            others[more.flags] = more.others
            totals += others[np.searchsorted(_distinct(key), distinct)]
        seen = np.zeros(len(doc))
        seen[at[open_]] = totals[which] - _own(doc[at[open_]], which, len(distinct))
        hit = seen[at] > 0
        value[at] += np.log(cfg.alpha)
        value[at[hit]] = np.log(seen[at[hit]]) - np.log(before[at[hit] - 1])
        backed[at] = ~hit
        before = seen
    sums = np.bincount(doc, weights=value, minlength=size)
    columns = [pa.array(chunk.docs, pa.int64()), pa.array(chunk.lengths, pa.int64()), pa.array(np.bincount(doc[backed], minlength=size), pa.int64()), pa.array(sums, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_backed_off", "log_score"])
