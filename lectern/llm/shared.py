"""What several operators share: scratch tables, word hashes, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.tables import discard, settings, shared_dir
from lectern.tables import scratch as scratch_path

__all__ = ["discard", "scratch_path", "settings", "shared_dir"]

T = TypeVar("T")

#: Entries of a worker's word cache; it is emptied when full, so its memory is bounded.
CACHE_WORDS = 150_000

LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def written(df: DataFrame, name: str, path: str | None = None, records: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation.

    Its shuffle files are deleted once it is written, so that a long job's disk is that of its largest step. records: rows
    of an Arrow batch on the way, for narrow rows that the session's setting would cut too small. options: of the writer.
    """
    path, spark = path or scratch_path(df.sparkSession, name), df.sparkSession
    values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    with settings(spark, values | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(records)} if records else {})):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame, records: int = 1000, size: str = "4m") -> DataFrame:
    """df, with the session's Arrow batches held to so many rows and bytes from now on.

    A batch of ten thousand whole texts is copied several times on its way to Python; small ones keep a task's memory
    independent of the length of texts.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > records:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def partitions_for(spark: SparkSession, size: int, few: int, most: int) -> int:
    """Into how many tasks to deal work of a size: of `few` each while cores are idle, and of `most` at most."""
    return max(1, -(-size // most), min(-(-size // few), 3 * spark.sparkContext.defaultParallelism))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its partitions as they are, stored in the shared folder."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that still read them must be stored before."""
    discard(spark, shared_dir(spark))


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def released() -> None:
    """Give memory that is free back to the system, and an earlier step's cache; large arrays come and go, and the allocators
    would keep it."""
    _caches.clear()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


_caches: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], T]) -> T:
    """A cache that a Python worker keeps from task to task. It holds one at a time: another operator's is dropped first,
    so that the stages of a long job don't add up in a worker that Spark uses again and again."""
    if name not in _caches:
        released()
        _caches[name] = make()
    return _caches[name]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(worker_cache("words", WordHashes).__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over the whole word."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[pa.RecordBatch]]]:
    """Runs of rows with equal leading columns (whole numbers without nulls), of a partition that is sorted by them."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(int(c[start]) for c in columns)
            if now is not None and key != now:
                yield now, held
                held = []
            now = key
            held.append(batch.slice(start, end - start))
    if now is not None:
        yield now, held


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest path. Joins and partial aggregations only: a node
    with very many edges is spread by AQE's skew handling and by map-side minima. Every round is
    written to the shared folder. No edges give an empty result.
    """
    a, b = F.col(u), F.col(v)
    one = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    both = F.explode(F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("near")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("near"))))
    links = written(one.select(both.alias("e")).select("e.*"), "links")
    labels = written(links.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component")), "labels")
    while True:
        seen = links.join(labels.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(F.min("component").alias("least_near"))
        step = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "least_near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        step = written(step.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("beyond", "to")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where(F.col("was") != F.col("component")).isEmpty():
            return labels
