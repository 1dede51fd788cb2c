"""One-shot runs over a table of papers: bulk ingestion, vectors, signals and analyses of what is missing or out of date.

Each run finds its work by a join with what is stored, makes the calls in tasks, stores their answers once, and publishes a new
version of the table. A run that stops loses nothing but its calls; the next one finds what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern import schemas
from lectern.functions import dates, jsons, text
from lectern.operators import dml, filters, vector_table
from lectern.sources import connectors, xml_feeds
from lectern.sources.artifacts import publish, published, versions
from lectern.streaming import ingest
from lectern.tables import stored

_VECTORS = StructType([f for f in schemas.PAPER_EMBEDDING if f.name in ("paper_id", "model_version", "vector")])


def bulk(spark: SparkSession, pages: str, base: str, since: str, oai_set: str | None = None, fetch: str | None = None) -> DataFrame:
    """The merged table after a harvest of OAI-PMH pages, recorded in a folder or fetched from a live service (harvest_pages).

    Only records changed on or after the day `since`, with a category of the set if one is given, are merged. base holds the
    pages' entries by batch, the table and the checkpoints, so a run goes on at the token where the last one stopped.
    """
    spark.dataSource.register(connectors.HarvestStream)

    def parse(batch: DataFrame, number: int) -> None:
        found = xml_feeds.oai_records_of(batch).where(F.col("updated_utc") >= F.to_timestamp_ntz(F.lit(f"{since} 00:00:00")))
        if oai_set is not None:
            found = found.where(F.exists("categories", lambda c: text.harvest_set(c) == oai_set))
        found.write.mode("overwrite").parquet(f"{base}/entries/d{number:012d}")

    rows = spark.readStream.format("harvest_pages").option("path", pages)
    rows = rows.option("fetch", fetch).load() if fetch else rows.load()
    query = rows.writeStream.foreachBatch(parse).option("checkpointLocation", f"{base}/harvested").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    schema = StructType(schemas.ENTRY.fields)
    if versions(spark, f"{base}/entries"):
        ingest.merge_stream(spark, f"{base}/entries/*", schema, f"{base}/table", f"{base}/merged", "arxiv_id", "updated_utc", newest=["updated_utc"]).awaitTermination()
    return ingest.current(spark, f"{base}/table", schema, "arxiv_id", ["updated_utc"])


def _stored_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    found = published(spark, path)
    return spark.createDataFrame([], schema) if found is None else found


def _passages(papers: DataFrame) -> DataFrame:
    """What a model gets; an empty text where title and abstract are null."""
    return connectors.passages(papers.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "abstract")}))


def embed(papers: DataFrame, path: str, model: str, call: Callable[[Sequence], Sequence] | None = None) -> tuple[DataFrame, int]:
    """(blocks, embedded): vectors of the papers that have none of the model, stored, and the model's table of blocks as the current one.

    call: from a list of passages to their vectors; without one, words are hashed. A paper's vector of another model is replaced.
    """
    spark = papers.sparkSession
    old = _stored_or_empty(spark, f"{path}/rows", _VECTORS)
    asked = _passages(filters.needs_embedding(papers, old, model))
    if call is None:
        fresh = asked.select("paper_id", connectors.stand_in_embedding(F.col("text")).cast("array<float>").alias("vector"))
    else:
        fresh = connectors.in_batches(asked, "paper_id", "text", call, "vector", "array<float>")
    fresh = stored(fresh, "fresh")
    embedded = fresh.count()
    if embedded:
        old = publish(spark, f"{path}/rows", dml.with_embeddings(old.withColumns({"q": F.lit(None).cast("array<int>"), "scale": F.lit(None).cast("float")}), fresh, model).select(*_VECTORS.names))
    current = vector_table.current(spark, f"{path}/blocks")
    if embedded or current is None or current[0] != model:
        return vector_table.write(old.where(F.col("model_version") == model), f"{path}/blocks", model), embedded
    return current[1], 0


_SIGNAL = "citation_count int, influential_citation_count int, github_stars int"


def enrich(papers: DataFrame, path: str, as_of: str, call: Callable[[Sequence], Sequence], days: int = 14) -> tuple[DataFrame, int, int]:
    """(signals, asked, answered): the table of signals after those that are missing or older than `days` were asked for.

    call: from a list of arxiv_ids to a dict for each (citation_count, influential_citation_count, github_stars), None where the
    service doesn't know it; such a paper's row stays as it was.
    """
    spark = papers.sparkSession
    old = _stored_or_empty(spark, path, schemas.PAPER_SIGNAL)
    due = filters.stale_signals(papers.where("arxiv_id is not null").select("paper_id", "arxiv_id"), old, as_of, days)
    page = stored(connectors.in_batches(due, "paper_id", "arxiv_id", call, "a", f"struct<{_SIGNAL.replace(' ', ':').replace(',:', ',')}>"), "signals")
    known = page.where("a is not null").select("paper_id", "a.*", dates.moment(as_of).alias("fetched_utc"))
    return publish(spark, path, dml.upsert(old, known, "paper_id")), page.count(), known.count()


def analyze(papers: DataFrame, paper_categories: DataFrame, path: str, category: str, as_of: str, model: str, call: Callable[[Sequence], Sequence], user_id: int | None = None, profile_version: int = 1, schema_version: int = 2) -> tuple[DataFrame, int, int]:
    """(analyses, asked, stored): the table after papers of a category without an analysis of the user's current profile were analysed.

    call: from a list of passages to the model's answers as JSON. An answer that breaks the contract isn't stored, so its paper
    is asked for again by the next run. Of a paper's analyses by one user the newest is kept.
    """
    spark = papers.sparkSession
    old = _stored_or_empty(spark, path, schemas.ANALYSIS_RESULT)
    own = papers.join(paper_categories.where(F.col("category") == category).select("paper_id").distinct(), "paper_id", "left_semi")
    asked = _passages(filters.stale(own, old, user_id, profile_version, schema_version))
    answers = stored(connectors.in_batches(asked, "paper_id", "text", call, "result_json", "string", size=20), "analyses")
    sound = answers.withColumn("a", jsons.analysis_of(F.col("result_json"))).where("a is not null")
    rows = sound.select(
        F.lit(user_id).cast("long").alias("user_id"), "paper_id", F.lit(schema_version).alias("schema_version"), F.lit(profile_version).alias("profile_version"),
        F.lit(model).alias("model"), "result_json", F.col("a.composite_score").cast("decimal(5,2)").alias("composite_score"), dates.moment(as_of).alias("created_utc"),
    )
    every = dml.newest_wins(old.select(*rows.columns).unionByName(rows), ["user_id", "paper_id"], ["created_utc", "profile_version", "schema_version"])
    return publish(spark, path, every), answers.count(), rows.count()
