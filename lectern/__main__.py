"""Command verbs: python -m lectern VERB ...; the exit code is 0 for a result, 1 for none or a failure, 2 for a wrong call."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern import queries, queries_more, queries_reports, schemas  # noqa: F401  register their queries
from lectern.operators import lexical, vector_table
from lectern.plans import evaluation, runs
from lectern.sources import connectors, xml_feeds
from lectern.streaming import ingest
from lectern.tables import local_session


def _shown(found: DataFrame) -> int:
    rows = found.limit(100).toPandas()
    print(rows.to_string(index=False))
    return 0 if len(rows) else 1


def _day(value: str) -> str:
    return date.fromisoformat(value).isoformat()


def _named(value: str) -> Callable:
    try:
        return connectors.named(value)
    except (ImportError, AttributeError) as error:
        raise ValueError(value) from error


def main(args: list[str]) -> int:
    """query NAME FOLDER: a registered query. index PAPERS PATH: the search index of a table of papers. search PATH TEXT: by
    words, from an index. bulk PAGES BASE --from DAY [--set SET] [--fetch MODULE:FUNCTION]: a harvest of stored or live pages merged
    into a table. embed PAPERS PATH MODEL [--call MODULE:FUNCTION]: vectors of papers that have none of the model. enrich PAPERS
    SIGNALS DAY --call: signals that are missing or old. analyze PAPERS TAGS ANALYSES CATEGORY DAY MODEL --call: papers of a
    category without a current analysis; 1 if an answer was no good. ingest FEEDS PAGES TABLE CHECKPOINT: feeds parsed to pages, and pages that are new merged into a
    table. evaluate RANKED JUDGMENTS LEAST: whether the mean nDCG is LEAST at least."""
    parser = argparse.ArgumentParser(prog="lectern", description=main.__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in {"query": ["name", "folder"], "index": ["papers", "path"], "search": ["path", "text"], "ingest": ["feeds", "pages", "table", "checkpoint"], "bulk": ["pages", "base"], "embed": ["papers", "path", "model"], "enrich": ["papers", "signals", "day"], "analyze": ["papers", "tags", "analyses", "category", "day", "model"], "evaluate": ["ranked", "judgments", "least"]}.items():
        sub = verbs.add_parser(verb)
        for name in names:
            sub.add_argument(name, type=_day if name == "day" else str)
        if verb in ("embed", "enrich", "analyze"):
            sub.add_argument("--call", type=_named, required=verb != "embed")
        if verb == "bulk":
            sub.add_argument("--from", dest="since", type=_day, required=True)
            sub.add_argument("--set", dest="oai_set")
            sub.add_argument("--fetch", type=lambda name: _named(name) and name)
    got = parser.parse_args(args)
    spark = local_session()
    if got.verb == "query":
        if got.name not in queries.QUERIES:
            parser.error(f"no query {got.name!r}")
        return _shown(queries.QUERIES[got.name](spark, got.folder))
    if got.verb == "index":
        lexical.build_index(spark.read.parquet(got.papers), got.path)
        return 0
    if got.verb == "search":
        index = lexical.open_index(spark, got.path)
        if index is None:
            parser.error(f"no index in {got.path}")
        asked = spark.createDataFrame([(1, got.text)], "query_id long, query_text string")
        return _shown(lexical.search_index(index, asked, 20).orderBy("rank"))
    if got.verb == "bulk":
        rows = runs.bulk(spark, got.pages, got.base, got.since, got.oai_set, got.fetch)
        return _shown(rows.agg(F.count("*").alias("papers"), F.max("updated_utc").alias("newest")))
    if got.verb == "embed":
        blocks, embedded = runs.embed(spark.read.parquet(got.papers), got.path, got.model, got.call)
        print(f"{embedded} embedded, {vector_table.rows(blocks).count()} in all")
        return 0
    if got.verb == "enrich":
        _, asked, answered = runs.enrich(spark.read.parquet(got.papers), got.signals, f"{got.day} 00:00:00", got.call)
        print(f"{asked} asked for, {answered} answered")
        return 0
    if got.verb == "analyze":
        _, asked, kept = runs.analyze(spark.read.parquet(got.papers), spark.read.parquet(got.tags), got.analyses, got.category, f"{got.day} 00:00:00", got.model, got.call)
        print(f"{asked} asked for, {kept} stored")
        return 0 if kept == asked else 1
    if got.verb == "ingest":
        entries = xml_feeds.atom_feed(spark, got.feeds)[1]
        entries.write.mode("append").parquet(got.pages)
        schema = StructType(schemas.ENTRY.fields)
        ingest.merge_stream(spark, got.pages, schema, got.table, got.checkpoint, "arxiv_id", "version").awaitTermination()
        rows = ingest.current(spark, got.table, schema, "arxiv_id")
        return _shown(rows.agg(F.count("*").alias("papers"), F.max("published_utc").alias("newest")))
    per = evaluation.metrics(spark.read.parquet(got.ranked), spark.read.parquet(got.judgments))
    verdict = evaluation.passes(per, float(got.least)).first()
    print(f"mean nDCG {verdict.mean_ndcg}: {'passed' if verdict.passed else 'failed'}")
    return 0 if verdict.passed else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
