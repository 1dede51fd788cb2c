"""Phrases of words that belong together, by hierarchical naming: two frequent neighbours get a name, and names of k words pair up to k + 1."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import discard, exists, grouped, in_small_batches, released, scratch_path, settings, written

#: Byte -> byte: letters lowered, tab to blank, marks that end a piece to a byte that no text in UTF-8 has.
_END = 0xFF
_TABLE = bytes(_END if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Of a name's 63 bits, those for its place in a chunk; above them a partition's 12 bits for its chunks.
_LOCAL, _CHUNKS = 31, 12


@dataclass(frozen=True)
class PhraseConfig:
    """least: occurrences of a phrase. longest: its words at most. covered: hundredths of a phrase's occurrences that a longer
    one must have to take its place. scale: of scores. top: phrases of a language. chunk_words: of a chunk, as far as documents
    end there. salts: tasks that rank a language's phrases first. slice_words, most_slices: a step is
    done in a slice for each so many words, up to so many, one after the other, so that its shuffle takes that part of the disk."""

    least: int = 30
    longest: int = 4
    covered: int = 80
    scale: int = 2_000_000
    top: int = 2000
    chunk_words: int = 1 << 21
    salts: int = 64
    slice_words: int = 1 << 24
    most_slices: int = 4


class _Steps:
    """A table that is written in slices, and dropped once it was used. kinds: rows with ids lie apart from the others."""

    def __init__(self, spark: SparkSession, name: str, schema: str, kinds: bool = False):
        self.spark, self.path, self.schema, self.kinds, self.n = spark, scratch_path(spark, name), schema, kinds, 0

    def write(self, df: DataFrame, records: int | None = None) -> None:
        values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "2"}
        with settings(self.spark, values | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)} if records else {})):
            rows = df.withColumn("kind", F.when(F.col("ids").isNull(), "rows").otherwise("ids")) if self.kinds else df
            writer = rows.write.option("compression", "zstd")
            (writer.partitionBy("kind") if self.kinds else writer).parquet(f"{self.path}/{self.n}")
        self.n += 1

    def read(self, kind: str | None = None) -> DataFrame:
        found = [p for p in (f"{self.path}/{k}" + (f"/kind={kind}" if kind else "") for k in range(self.n)) if exists(self.spark, p)]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def drop(self, kind: str | None = None) -> None:
        discard(self.spark, *((f"{self.path}/{k}/kind={kind}" for k in range(self.n)) if kind else [self.path]))


class _Local(dict):
    """A language's words -> numbers in a chunk."""

    def __init__(self, lang: str, numbers: Iterator[int], names: list):
        super().__init__({b"\xff": 0})
        self.lang, self.numbers, self.names = lang, numbers, names

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.numbers)
        self.names.append((self.lang, word))
        return n


_ROW = "place long, n int, ids binary"
_WORDS = f"{_ROW}, lang string, word string"
_PAIRS = f"{_ROW}, a long, b long"


def _arrow(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(size, kinds[t]) for c, t in fields], [c for c, _ in fields])


def _packed(chunk: int, ids: np.ndarray, schema: str) -> pa.RecordBatch:
    return _arrow(schema, place=[chunk << _LOCAL], ids=[np.ascontiguousarray(ids, np.int32).tobytes()])


def chunks(docs: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """Texts as chunks of words' numbers, a row (place, ids) each, with 0 where a piece ends; and a row (place, n, lang, word) for
    each of its words. A place is a chunk and a number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << _CHUNKS
        numbers, names, by_lang, parts, size = count(1), [], {}, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(parts)
            yield _packed(chunk, ids, _WORDS)
            n = np.bincount(ids, minlength=len(names) + 1)[1:]
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                yield _arrow(_WORDS, place=(chunk << _LOCAL) + np.arange(k + 1, k + len(part) + 1), n=n[k : k + len(part)], lang=[x for x, _ in part], word=[w.decode("utf-8", "replace") for _, w in part])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (local := by_lang.get(lang)) is None:
                    local = by_lang[lang] = _Local(lang, numbers, names)
                words = text.encode().translate(_TABLE).replace(b"\xff", b" \xff ").split()
                words.append(b"\xff")
                parts.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= cfg.chunk_words:
                    yield from closed()
                    chunk, numbers, names, by_lang, parts, size = chunk + 1, count(1), [], {}, [], 0
        if parts:
            yield from closed()
        released()

    texts = in_small_batches(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''"))
    return texts.mapInArrow(run, _WORDS)


def paired(arrays: DataFrame, names: DataFrame, last: bool) -> DataFrame:
    """The next level: of chunks of numbers (place, ids) and the names (place, id) of those that are frequent, chunks of the numbers
    of pairs of frequent neighbours (not for the last level), and a row (place, n, a, b) for each pair, of the names a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), parts in grouped(batches, 1):
            block = pa.Table.from_batches(parts)
            local, name = block.column("local"), block.column("id")
            ids = np.frombuffer(next(x for x in block.column("ids").to_pylist() if x is not None), np.int32)
            known = local.is_valid()
            places, held = local.filter(known).to_numpy(), name.filter(known).to_numpy()
            table = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
            table[places] = np.arange(1, len(places) + 1, dtype=np.int32)
            now = table[ids]
            left, right = now[:-1], now[1:]
            at = np.flatnonzero((left > 0) & (right > 0))
            pairs, numbers, n = np.unique(left[at].astype(np.int64) * (len(places) + 1) + right[at], return_inverse=True, return_counts=True)
            if not last:
                out = np.zeros(len(ids), np.int32)
                out[at] = numbers + 1
                yield _packed(chunk, out, _PAIRS)
            a, b = held[pairs // (len(places) + 1) - 1], held[pairs % (len(places) + 1) - 1]
            for k in range(0, len(pairs), 50_000):
                part = slice(k, k + 50_000)
                yield _arrow(_PAIRS, place=(chunk << _LOCAL) + np.arange(k + 1, k + len(a[part]) + 1), n=n[part], a=a[part], b=b[part])
        released()

    none = lambda kind: F.lit(None).cast(kind)
    chunk, local = F.shiftright("place", _LOCAL), F.col("place").bitwiseAND(F.lit((1 << _LOCAL) - 1)).cast("int")
    rows = arrays.select(chunk.alias("chunk"), none("int").alias("local"), none("long").alias("id"), "ids")
    rows = rows.unionByName(names.select(chunk.alias("chunk"), local.alias("local"), "id", none("binary").alias("ids")))
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, _PAIRS)


def named(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Of rows (place, n, keys) those whose keys occur at least `least` times in all chunks: (place, id), and f, how often, with the
    keys in the first of them, whose place is the id. A key has a row in a chunk at most, so no task gets more rows of it than
    there are chunks."""
    over = W.partitionBy(*keys)
    counted = rows.withColumn("f", F.sum("n").over(over)).withColumn("id", F.min("place").over(over))
    first = F.col("place") == F.col("id")
    return counted.where(F.col("f") >= least).select("place", "id", *(F.when(first, F.col(c)).alias(c) for c in ("f", *keys)))


def _parents(level: DataFrame, below: DataFrame, *columns: str) -> DataFrame:
    """level (id, a, b, f) with columns of the names below that it points to, those of a and of b."""
    side = lambda c: below.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in columns))
    return level.join(side("a"), "a").join(side("b"), "b")


def _wide(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _scored(rows: DataFrame, cuts: list[tuple[Column, Column]], cfg: PhraseConfig) -> DataFrame:
    """rows with l, r and score of their weakest cut: exact, in decimals, as products may pass 64 bits."""
    exact = lambda l, r: F.call_function("div", F.col("f").cast("decimal(19,0)") * F.lit(cfg.scale).cast("decimal(18,0)"), l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))  # noqa: E731, E741
    options = F.array(*(F.struct(exact(l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k, (l, r) in enumerate(cuts, 1)))  # noqa: E741
    return rows.withColumn("cut", F.array_min(options))


def _covered(level: DataFrame, above: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """level without the phrases that a phrase one word longer stands for; longer ones still occur no more often than these."""
    best = above.select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("g")).groupBy("id").agg(F.max("g").alias("g"))
    joined = level.join(best, "id", "left")
    return joined.where(F.col("g").isNull() | (_wide(F.col("g")) * 100 < _wide(F.col("f")) * cfg.covered)).drop("g")


def top_phrases(found: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """The best of each language with their rank: first of each salt, then of these."""
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    salted = found.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(cfg.salts)))
    part = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= cfg.top)
    return part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= cfg.top).drop("_s")


def phrases(docs: DataFrame, cfg: PhraseConfig = PhraseConfig()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to four words of each language of docs (lang, text).

    1. Texts become chunks of numbers, and each distinct word of a chunk a row. Words that are frequent in all chunks get a
       name, which is joined back to the chunks that have them.
    2. Neighbours that both have a name are a pair. Distinct pairs of a chunk are rows, the frequent ones get a name, and so on
       to phrases of four words. A phrase is thus named by its first and its last words but one, and all its parts have names.
    3. These names are pointers: the frequencies of the parts that a cut leaves, and of longer phrases that hold a phrase, are
       found by following them.

    What moves is numbers, distinct words and distinct pairs; a chunk's arrays are in one task, of a size that is set. All
    frequencies are those of the whole table. Defined cases: null and empty texts have no words; a null language is und, as is
    one with that name; repeated rows count each; a text longer than a chunk is a chunk of its own; equal scores are in the
    order of frequency, then of the phrase's bytes; other columns are ignored; a table without frequent phrases gives no rows.
    """
    spark = docs.sparkSession
    table = _Steps(spark, "chunks", _WORDS, kinds=True)
    table.write(chunks(docs, cfg))
    totals = written(table.read("rows").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    slices = 1 + min(cfg.most_slices - 1, (totals.agg(F.sum("n")).first()[0] or 0) // cfg.slice_words)
    names, keys, levels, words = None, ["lang", "word"], [], None
    for k in range(1, cfg.longest + 1):
        if k > 1:
            pairs = _Steps(spark, "pairs", _PAIRS, kinds=True)
            chunk = F.pmod(F.shiftright("place", _LOCAL), F.lit(slices))
            for s in range(slices):
                pairs.write(paired(table.read("ids").where(chunk == s), names.read().where(chunk == s), k == cfg.longest), 50_000)
            table.drop(), names.drop()
            table, keys = pairs, ["a", "b"]
        rows = table.read("rows").select("place", "n", *keys)
        names = _Steps(spark, "names", ", ".join(f"{c} {t}" for c, t in named(rows, keys, cfg.least).dtypes))
        for s in range(slices):
            names.write(named(rows.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == s), keys, cfg.least))
        table.drop("rows")
        first = written(names.read().where("f is not null").select("id", *keys, "f"), "level")
        if k == 1:
            words = first
        else:
            levels.append(first)
    table.drop(), names.drop()
    # of each name: head and tail are its first and last word; front and back its first and last words but one, by how often they occur
    known = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), "f", F.array().cast("array<long>").alias("fronts"), F.array().cast("array<long>").alias("backs"))
    found = []
    for level in levels:
        rows = _parents(level, known, "lang", "phrase", "tail", "f", "fronts", "backs")
        rows = rows.select("id", "a", "b", "f", F.col("a_lang").alias("lang"), F.concat("a_phrase", F.lit(" "), "b_tail").alias("phrase"), F.col("b_tail").alias("tail"), F.concat("a_fronts", F.array("a_f")).alias("fronts"), F.concat(F.array("b_f"), "b_backs").alias("backs"))
        known = written(rows, "phrases")
        found.append(known)
    out = None
    for k, level in enumerate(found):
        kept = _covered(level, found[k + 1], cfg) if k + 1 < len(found) else level
        cuts = [(F.element_at("fronts", i + 1), F.element_at("backs", i + 1)) for i in range(k + 1)]
        rows = _scored(kept, cuts, cfg).select("lang", "phrase", "f", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    best = top_phrases(out, cfg).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
