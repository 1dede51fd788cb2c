"""Incremental ingestion: pages arrive as files, each micro-batch is merged once, derived marks follow."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from lectern import schemas
from lectern.functions import dates
from lectern.operators import dml
from lectern.sources.artifacts import publish, published, versions
from lectern.streaming.queue import WorkQueue
from lectern.tables import discard, stored


def _read(spark: SparkSession, path: str, schema: StructType, base: str | None, deltas: Sequence[str]) -> DataFrame:
    numbered = StructType([*schema.fields, StructField("_batch", LongType())])
    rows = spark.createDataFrame([], numbered)
    for version in ([base] if base else []) + list(deltas):  # compact_every of them at most
        rows = rows.unionByName(spark.read.schema(numbered).parquet(f"{path}/{version}"))
    return rows


def _parts(spark: SparkSession, path: str, before: int | None = None) -> tuple[str | None, list[str]]:
    """The newest base of a table and the deltas after it, each written whole; before: only those of earlier batches."""
    found = [v for v in versions(spark, path) if before is None or int(v[1:]) < before]
    base = max((v for v in found if v[0] == "b"), default=None)
    return base, sorted(v for v in found if v[0] == "d" and (base is None or v[1:] > base[1:]))


def current(spark: SparkSession, path: str, schema: StructType, key: str, newest: Sequence[str] = ()) -> DataFrame:
    """The rows of a merged table: of each key the one of the last batch, or with newest the last by these columns. Empty before the first batch."""
    rows = _read(spark, path, schema, *_parts(spark, path))
    return dml.newest_wins(rows, [key], [*newest, "_batch"]).drop("_batch")


def merge_stream(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, key: str, order: str, files_per_batch: int = 1000, after: Callable[[DataFrame, int], None] | None = None, newest: Sequence[str] = (), compact_every: int = 16) -> StreamingQuery:
    """Merge every file of new pages into a table, then stop: run it again for the files that have come since.

    The checkpoint says which files are done, so a run goes on where the last one stopped. Within a batch the last row of a
    key (by `order`) counts. A batch writes its own rows only, under its number: merging it again writes the same. Each
    compact_every batches these are folded into a new base; the base and rows before the last one are deleted.
    """

    def merge(page: DataFrame, batch: int) -> None:
        session = page.sparkSession
        fresh = dml.newest_wins(page, [key], [order])
        fresh.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{table}/d{batch:012d}")
        if (batch + 1) % compact_every == 0:
            base, deltas = _parts(session, table, batch + 1)
            rows = dml.newest_wins(_read(session, table, schema, base, deltas), [key], [*newest, "_batch"])
            rows.write.mode("overwrite").parquet(f"{table}/b{batch:012d}")
            if base:
                discard(session, *(f"{table}/{v}" for v in versions(session, table) if v[1:] < base[1:] or v == f"d{base[1:]}"))
        if after:
            after(fresh, batch)

    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Append new files' rows to a log."""
    rows = transform(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work_stream(spark: SparkSession, source: str, schema: StructType, results: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str, most_attempts: int = 5, lease: float = 90.0, retry: float = 0.0, clock: Callable[[], float] = time.time) -> StreamingQuery:
    """A queue of work items (key, attempts): items that wait in the queue and are visible are worked on, then each micro-batch's.

    The queue (WorkQueue) is in results, whose done and poison folders hold what was done and put aside. An item for which work
    gives no result is visible again after `retry` seconds, one whose consumer stopped after `lease`. Delivery is at least once:
    a micro-batch that comes again adds nothing, and a key has one result.
    """
    queue = WorkQueue(spark, results, schema, key, most_attempts, lease, retry)
    if not queue.waiting().isEmpty():
        queue.deliver(work, clock())

    def consume(items: DataFrame, batch: int) -> None:
        queue.add(items)
        queue.deliver(work, clock())

    items = spark.readStream.schema(schema).parquet(source)
    return items.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RowCounter(StreamingQueryListener):
    """Rows that each streaming query has taken in, counted by batch as they are reported; a batch that comes again counts once.

    A query itself keeps the reports of its last batches only. Register it with spark.streams.addListener before a query starts.
    """

    def __init__(self) -> None:
        self.rows: dict[str, dict[int, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.id), {})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows.setdefault(str(event.progress.id), {})[event.progress.batchId] = event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def processed(query: StreamingQuery, counter: RowCounter | None = None, patience: float = 30.0) -> int:
    """Rows that a stream has taken in so far. With a counter of all batches: reports come a little later, so the last one is waited
    for. Without one of those whose reports Spark still keeps, 100 by default."""
    if counter is None:
        return sum(p.numInputRows for p in query.recentProgress)
    last, until = query.lastProgress, time.monotonic() + patience
    while last is not None and last.batchId not in counter.rows.get(str(query.id), {}) and time.monotonic() < until:
        time.sleep(0.05)
    return sum(counter.rows.get(str(query.id), {}).values())


def ingest_run(spark: SparkSession, base: str, categories: DataFrame, fetch: Callable[[str, datetime], DataFrame], as_of: str, key: str, schema: StructType, time_column: str, fallback_days: int, name: str | None = None) -> DataFrame:
    """One run over all categories: window, fetch, merge, mark and audit; returns its audit row.

    base holds versioned tables: papers (rows of schema, merged by key), marks (category, high_water_mark_utc) and runs. The run
    shows as Running from its start; runs that an earlier crash left so are closed as Failed. A category is fetched from its mark
    on, and what came is stored before it is merged; of a paper that several have the first one's row counts. One whose fetch fails
    keeps its mark, and the others go on. Papers are published
    before marks, and marks before the audit, so after a crash anywhere the next run fetches again what may be missing, and merging
    a row again changes nothing.
    """
    run, columns = name or run_id(), [f.name for f in schema]
    runs = published(spark, f"{base}/runs")
    blank = spark.createDataFrame([], RUN)
    closed = (blank if runs is None else runs).withColumn("error", F.when(F.col("status") == "Running", "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(F.col("status") == "Running", "Failed").otherwise(F.col("status")))
    running = spark.createDataFrame([(run, "Running", 0, 0, 0, None)], RUN)
    publish(spark, f"{base}/runs", closed.unionByName(running).coalesce(1))
    papers, marks = published(spark, f"{base}/papers"), published(spark, f"{base}/marks")
    papers = spark.createDataFrame([], schema) if papers is None else papers
    marks = spark.createDataFrame([], MARK) if marks is None else marks
    windows = fetch_windows(categories, marks, as_of, fallback_days).orderBy("category").collect()  # configured categories
    fetched: dict[str, DataFrame] = {}

    def one(category: str) -> tuple[int, int, int]:
        page = f"{base}/pages/{run}/{len(fetched)}"
        fetch(category, since[category]).select(*columns).write.mode("overwrite").parquet(page)
        fetched[category] = spark.read.schema(schema).parquet(page)
        return 0, 0, 0

    since = {w.category: w.since for w in windows}
    parts = run_parts(spark, run, since, one)
    if fetched:
        every = reduce(DataFrame.unionByName, (rows.withColumns({"_part": F.lit(c), "_new": F.lit(len(fetched) - k)}) for k, (c, rows) in enumerate(fetched.items())))
        once = stored(dml.newest_wins(every, [key], ["_new", time_column]), "page")
        change = dml.upsert_diff(papers, once.select(*columns), key, [c for c in columns if c != key]).join(once.select(key, "_part"), key)
        counts = stored(change.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("f"), F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "updated").alias("u")), "counts")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        parts = parts.join(counts, "part", "left").select("run_id", "part", zero("f").alias("fetched"), zero("a").alias("added"), zero("u").alias("updated"), "error")
        publish(spark, f"{base}/papers", papers.join(once.select(key), key, "left_anti").unionByName(once.select(*columns)))
        newest = every.groupBy(F.col("_part").alias("category")).agg(F.max(time_column).alias("high_water_mark_utc"))
        publish(spark, f"{base}/marks", marks.unionByName(newest).groupBy("category").agg(F.max("high_water_mark_utc").alias("high_water_mark_utc")).where("high_water_mark_utc is not null"))
    summary = dml.run_summary(parts).select(F.col("run_id").alias("run"), "status", "fetched", "added", "updated", F.when(F.col("error") != "", F.col("error")).alias("error"))
    publish(spark, f"{base}/runs", published(spark, f"{base}/runs").where(F.col("run") != run).unionByName(summary).coalesce(1))
    return published(spark, f"{base}/runs").where(F.col("run") == run)


RUN = "run string, status string, fetched long, added long, updated long, error string"
MARK = "category string, high_water_mark_utc timestamp_ntz"


def fetch_windows(categories: DataFrame, marks: DataFrame, as_of: str, fallback_days: int) -> DataFrame:
    """(category, since): from when to fetch each category: its mark, back to the full minute so that the boundary is
    fetched again, or some days for one without a mark."""
    known = categories.select("category").join(marks, "category", "left")
    return known.select("category", F.coalesce(dates.minute_of(F.col("high_water_mark_utc")), dates.cutoff(as_of, fallback_days)).alias("since"))


def boundary_refetch(seen: DataFrame, available: DataFrame, windows: DataFrame, key: str, time: str) -> DataFrame:
    """seen (with category) after a fetch of what is available since each category's window: the boundary comes twice and is kept once."""
    fetched = available.join(windows, "category").where(F.col(time) >= F.col("since")).select(*seen.columns)
    return dml.newest_wins(seen.unionByName(fetched), [key], [time])


def run_parts(spark: SparkSession, run_id: str, parts: Iterable[str], work: Callable[[str], tuple[int, int, int]]) -> DataFrame:
    """A row (run_id, part, fetched, added, updated, error) for each part of a run, each worked on by itself: one that fails
    leaves its error, and the others go on. dml.run_summary makes the run's audit row of them."""
    rows = []
    for part in parts:  # configured categories
        try:
            rows.append((run_id, part, *work(part), None))
        except Exception as error:  # noqa: BLE001  the run's audit keeps it
            rows.append((run_id, part, 0, 0, 0, f"{part}: {error}"))
    return spark.createDataFrame(rows, schemas.RUN_PART)


def run_id() -> str:
    return uuid.uuid4().hex
