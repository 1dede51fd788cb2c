"""A queue of work items as versioned tables: deliveries with a visibility time, delayed retries, items put aside after too many."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import dml
from lectern.sources.artifacts import publish, versions


@dataclass(frozen=True)
class WorkQueue:
    """Items (schema, with key and attempts) in a folder that driver and executors share.

    open/: versions of the items that wait, with visible_at; done/ and poison/: a version for each delivery, what it gave and what
    was put aside. A delivery first publishes that its items are taken (attempts one more, invisible for `lease` seconds), then
    works, then publishes what is left: failed ones are visible again after `retry` seconds. A consumer that stops in between
    loses nothing: its results count if they were stored, and its items come again when their lease is over. An item that was
    delivered most_attempts times is put aside at its next turn. There is one consumer at a time, of any number of tasks.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    most_attempts: int = 5
    lease: float = 90.0
    retry: float = 10.0

    @property
    def _columns(self) -> list[str]:
        return [f"{f.name} {f.dataType.simpleString()}" for f in self.schema] + ["visible_at double"]

    def _version(self) -> int:
        found = versions(self.spark, f"{self.path}/open")
        return int(found[-1][1:]) if found else 0

    def waiting(self) -> DataFrame:
        """The items of the newest version, with visible_at."""
        schema, n = ", ".join(self._columns), self._version()
        return self.spark.read.schema(schema).parquet(f"{self.path}/open/v{n:012d}") if n else self.spark.createDataFrame([], schema)

    def _keys(self, kind: str) -> DataFrame:
        """Keys of whole deliveries."""
        paths = [f"{self.path}/{kind}/{v}" for v in versions(self.spark, f"{self.path}/{kind}")]
        field = self.schema[self.key]
        none = self.spark.createDataFrame([], StructType([field]))
        return self.spark.read.parquet(*paths).select(F.col(self.key).cast(field.dataType)) if paths else none

    def add(self, items: DataFrame) -> None:
        """Items whose key is new; of one key the item with most attempts. Adding items again changes nothing."""
        once = dml.newest_wins(items, [self.key], ["attempts"]).select(*(f.name for f in self.schema), F.lit(0.0).alias("visible_at"))
        old = self.waiting()
        for known in (old.select(self.key), self._keys("done"), self._keys("poison")):
            once = once.join(known, self.key, "left_anti")
        publish(self.spark, f"{self.path}/open", old.unionByName(once))

    def deliver(self, work: Callable[[DataFrame], DataFrame], now: float) -> None:
        """One delivery of all items that are visible; work gives a row with the key for each that it could do."""
        items, names = self.waiting().join(self._keys("done"), self.key, "left_anti"), [f.name for f in self.schema]
        n = self._version() + 1
        due, spent = F.col("visible_at") <= now, F.col("attempts") >= self.most_attempts
        items.where(due & spent).select(*names).write.mode("overwrite").parquet(f"{self.path}/poison/v{n:012d}")
        kept = items.where(~(due & spent)).withColumn("_due", due)
        taken = kept.withColumn("attempts", F.when(due, F.col("attempts") + 1).otherwise(F.col("attempts"))).withColumn("visible_at", F.when(F.col("_due"), now + self.lease).otherwise(F.col("visible_at")))
        claimed = publish(self.spark, f"{self.path}/open", taken.select(*names, "visible_at", "_due"))
        mine = claimed.where("_due")
        given = mine.select(*names).withColumn("attempts", F.col("attempts") - 1)
        done = f"{self.path}/done/v{n:012d}"
        work(given).join(self._keys("done"), self.key, "left_anti").write.mode("overwrite").parquet(done)
        left = claimed.join(self.spark.read.parquet(done).select(self.key), self.key, "left_anti")
        later = F.when(F.col("_due"), F.lit(now + self.retry)).otherwise(F.col("visible_at"))
        publish(self.spark, f"{self.path}/open", left.select(*names, later.alias("visible_at")))

    def results(self) -> DataFrame | None:
        """What the deliveries gave, a row for each key; None before the first."""
        paths = [f"{self.path}/done/{v}" for v in versions(self.spark, f"{self.path}/done")]
        return self.spark.read.parquet(*paths) if paths else None
