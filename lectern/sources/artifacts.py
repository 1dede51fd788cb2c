"""Evaluation artifacts, corpus exports, derived index tables and append-only logs."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.tables import discard


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each query of a query set; a missing file is an error."""
    return spark.read.schema(schemas.EVAL_QUERIES).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each judgment; a missing file is an empty set."""
    rows = lambda df: df.select("rubricVersion", F.explode("judgments").alias("j")).select("rubricVersion", "j.*")
    try:
        return rows(spark.read.schema(schemas.JUDGMENTS).json(path, multiLine=True))
    except AnalysisException:
        return rows(spark.createDataFrame([], schemas.JUDGMENTS))


def export_corpus(papers: DataFrame, judged: DataFrame, path: str) -> None:
    """The judged papers in the order of their ids, as gzipped JSON lines."""
    kept = papers.join(judged.select("arxiv_id").distinct(), "arxiv_id", "left_semi")
    kept.repartitionByRange("arxiv_id").sortWithinPartitions("arxiv_id").write.mode("overwrite").option("compression", "gzip").json(path)


def seed_corpus(spark: SparkSession, export: str, path: str, schema) -> DataFrame:
    """An exported corpus as a table; an existing table is an error."""
    spark.read.schema(schema).json(export).write.mode("errorifexists").parquet(path)
    return spark.read.schema(schema).parquet(path)


def snapshot_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """A derived table as stored; if it is missing or can't be read it is built and stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return spark.read.parquet(path)


def publish(spark: SparkSession, path: str, rows: DataFrame, kept: int = 2) -> DataFrame:
    """A new version of a derived table, which readers see once it is whole; of older versions `kept` in all stay, so that a
    reader of the last one isn't cut off."""
    found = versions(spark, path)
    name = f"v{int(found[-1][1:]) + 1 if found else 1:012d}"
    rows.write.parquet(f"{path}/{name}")
    discard(spark, *(f"{path}/{old}" for old in [*found, name][:-kept]))
    return spark.read.schema(rows.schema).parquet(f"{path}/{name}")


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a derived table; None if there is none."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/{found[-1]}") if found else None


def versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions of a table folder, oldest first: those whose writer left its mark."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(root) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a log."""
    rows.write.mode("append").parquet(path)


def record_usage(rows: DataFrame, path: str) -> bool:
    """Add rows to the usage ledger. A failure is logged and not raised: the metered call has been made, and its caller gets its answer."""
    try:
        append(rows, path)
    except Exception:  # noqa: BLE001  whatever the store's trouble is
        logging.getLogger(__name__).exception("usage was not recorded in %s", path)
        return False
    return True
