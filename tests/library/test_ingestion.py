from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources import artifacts
from lectern.streaming import ingest
from lectern.streaming.queue import WorkQueue

ITEM = T.StructType([T.StructField("id", T.LongType()), T.StructField("attempts", T.IntegerType())])
PAPER = T.StructType([T.StructField("paper", T.StringType()), T.StructField("title", T.StringType()), T.StructField("at", T.TimestampNTZType())])


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_a_batch_that_comes_again_keeps_results(spark, tmp_path):
    source, results, check = (str(tmp_path / x) for x in ("items", "results", "check"))
    spark.createDataFrame([(k, 0) for k in range(6)], ITEM).coalesce(1).write.parquet(source)
    run = lambda: ingest.work_stream(spark, source, ITEM, results, check, lambda d: d.select("id").where("id % 2 = 0"), "id", retry=1000.0).awaitTermination()
    run()
    queue = WorkQueue(spark, results, ITEM, "id")
    assert ids(queue.results()) == [0, 2, 4]
    for f in (tmp_path / "check" / "commits").glob("*0*"):  # as after a crash between results and commit
        f.unlink()
    run()
    assert ids(queue.results()) == [0, 2, 4] and ids(queue.waiting()) == [1, 3, 5]


def test_leases_retries_and_poison(spark, tmp_path):
    queue = WorkQueue(spark, str(tmp_path / "queue"), ITEM, "id", most_attempts=3)
    queue.add(spark.createDataFrame([(1, 0), (2, 0), (2, 0)], ITEM))

    def stopped(items):
        raise RuntimeError("consumer stopped")

    with pytest.raises(RuntimeError):
        queue.deliver(stopped, 100.0)
    one = lambda d: d.select("id").where("id = 1")
    queue.deliver(one, 150.0)
    assert ids(queue.results()) == []  # its lease isn't over
    queue.deliver(one, 191.0)
    assert ids(queue.results()) == [1] and [tuple(r) for r in queue.waiting().collect()] == [(2, 2, 201.0)]
    queue.deliver(lambda d: d.select("id"), 195.0)
    assert ids(queue.results()) == [1]  # a failed item waits
    queue.add(spark.createDataFrame([(1, 0), (2, 0)], ITEM))
    queue.deliver(one, 202.0)
    queue.deliver(lambda d: d.select("id"), 300.0)  # three deliveries were all
    assert ids(queue.results()) == [1] and ids(queue.waiting()) == []
    assert ids(spark.read.parquet(str(tmp_path / "queue/poison/*"))) == [2]


def test_rows_of_all_batches_are_counted(spark, tmp_path):
    schema = T.StructType([T.StructField("v", T.LongType())])
    for k in range(6):
        spark.range(k + 1).select(F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counter = ingest.RowCounter()
    spark.streams.addListener(counter)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert ingest.processed(query, counter) == 21 > ingest.processed(query)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(counter)


def test_runs_resume_after_a_crash(spark, tmp_path):
    base, cats = str(tmp_path / "base"), spark.createDataFrame([("a",), ("b",)], "category string")
    at = lambda day: datetime(2024, 12, day, 10, 30, 20)
    known = {"a": [("p1", "one", at(20)), ("p2", "two", at(22))], "b": [("p2", "two", at(22)), ("p3", "three", at(25))]}
    asked, broken = [], set()

    def fetch(category, since):
        asked.append((category, since))
        if category in broken:
            raise OSError("no answer")
        return spark.createDataFrame([r for r in known[category] if r[2] >= since], PAPER)

    run = lambda name: tuple(ingest.ingest_run(spark, base, cats, fetch, "2024-12-31 00:00:00", "paper", PAPER, "at", 30, name).first())
    marks = lambda: {r.category: r.high_water_mark_utc for r in artifacts.published(spark, f"{base}/marks").collect()}
    broken.add("b")
    assert run("r1") == ("r1", "Completed", 2, 2, 0, "b: no answer")
    assert marks() == {"a": at(22)} and asked == [("a", datetime(2024, 12, 1)), ("b", datetime(2024, 12, 1))]
    broken.clear()
    asked.clear()
    known["a"][1] = ("p2", "two again", at(22))
    known["a"].append(("p4", "four", at(26)))
    real = ingest.publish

    def crash(session, path, *rest, **more):
        if path.endswith("/marks"):
            raise KeyboardInterrupt
        return real(session, path, *rest, **more)

    ingest.publish = crash
    try:
        with pytest.raises(KeyboardInterrupt):
            run("r2")
    finally:
        ingest.publish = real
    assert marks() == {"a": at(22)}
    assert run("r3") == ("r3", "Completed", 3, 0, 0, None)  # fetched again, but all is there already
    assert asked[2:] == [("a", datetime(2024, 12, 22, 10, 30)), ("b", datetime(2024, 12, 1))]
    assert marks() == {"a": at(26), "b": at(25)}
    assert {r.run: (r.status, r.error) for r in artifacts.published(spark, f"{base}/runs").collect()} == {"r1": ("Completed", "b: no answer"), "r2": ("Failed", "interrupted"), "r3": ("Completed", None)}
    assert {r.paper: r.title for r in artifacts.published(spark, f"{base}/papers").collect()} == {"p1": "one", "p2": "two again", "p3": "three", "p4": "four"}
