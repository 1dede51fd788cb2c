"""Registered queries against their SQL, on tables with what small ones lack: rare roundings, large ids, odd rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern import queries, queries_more, queries_reports  # noqa: F401
from lectern.operators import lexical
from lectern.tables import scratch
from tests.library.test_functions import halves


def both(spark, folder, name):
    """A query's rows by Spark and by SQL, over the tables in folder."""
    frame = queries.QUERIES[name](spark, str(folder))
    columns = sorted(frame.columns)
    db = duckdb.connect()
    for path in folder.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}/*.parquet'")
    sql = db.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr), sorted(sql, key=repr)


@pytest.mark.parametrize("name", ["embedding_run", "int8_quantize"])
def test_halves_of_a_scale(spark, tmp_path, name):
    rows = [(k, v, 0) for k, v in enumerate(halves())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found, expected = both(spark, tmp_path, name)
    assert len(found) == len(rows) and found == expected


def test_slots_of_more_papers_than_five_digits(spark, tmp_path):
    spark.range(100_040).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'src1' AS source", "1 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    events = spark.createDataFrame([(k, 1, "view") for k in (1000, 1001, 14288, 14289, 14290)], "event_id long, user_id long, event_type string")
    events.selectExpr("event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    found, expected = both(spark, tmp_path, "surrogate_key_slots")
    assert any(paper >= 100_000 for paper, _, _ in expected) and found == expected


def test_weights_of_a_search_do_not_move(spark):
    """A search of all texts deals papers' words by paper; neither weights nor sums, of which a query has one for each paper, are shuffled."""
    papers = queries.Corpus(spark, "/root/testdata/sf0.001").papers
    asked = spark.createDataFrame([(k, "the of and thstin") for k in range(3)], "query_id long, query_text string")
    plan = lexical.bm25(papers, asked, 5)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert any(d.startswith("paper_id#") for d in dealt) and not any("query_id" in d and "paper_id" in d for d in dealt)


@pytest.mark.parametrize("name", ["recall_at_50", "ndcg_at_10", "mrr", "eval_report"])
def test_a_single_evaluation_builds_no_index(spark, name):
    assert not any("/lexicon-" in f for f in queries.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles())


def test_equally_frequent_words_are_weighed_for_the_best_alone(spark):
    """Where bounds spare nothing, only papers that come up to the best sums are rows of weights."""
    rng, path = random.Random(5), scratch(spark, "index")
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    rows = [(k, "t", " ".join(rng.choices(words, k=40))) for k in range(1500)]
    lexical.build_index(spark.createDataFrame(rows, "paper_id long, title string, abstract string").withColumn("published_utc", F.lit("2024-01-01").cast("timestamp_ntz")), path)
    asked = spark.createDataFrame([(k, " ".join(rng.sample(words, 12))) for k in range(5)], "query_id long, query_text string")
    index = lexical.open_index(spark, path)
    every = index.postings.join(lexical.query_terms(asked), "term").count()
    assert lexical.pruned_weights(index, asked, 10)[0].count() < every / 20
    rows = lambda found: sorted((r.query_id, r.paper_id, r["rank"], round(r.score, 9)) for r in found.collect())
    assert rows(lexical.search_best(index, asked, 10)) == rows(lexical.search_index(index, asked, 10))
