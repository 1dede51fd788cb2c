import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import dense, dense_many, filters, lexical, vector_table
from lectern.plans import search
from lectern.tables import scratch

AS_OF = "2024-12-31 00:00:00"
WORDS = "alpha beta gamma delta eps zeta eta theta".split()


def papers_of(spark, rows):
    return spark.createDataFrame(rows, "paper_id long, title string, abstract string").withColumn("published_utc", F.lit("2024-01-01").cast("timestamp_ntz"))


def text_of(rng):
    return " ".join(rng.choices(WORDS, weights=[40, 20, 10, 5, 3, 2, 1, 1], k=rng.randrange(0, 30)))


def ranked(found):
    return sorted((r.query_id, r.paper_id, r["rank"], round(r.score, 9)) for r in found.collect())


def test_an_updated_index_answers_like_a_new_one(spark):
    rng, path = random.Random(3), scratch(spark, "index")
    corpus = {k: (k, "title", text_of(rng)) for k in range(60)}
    queries = spark.createDataFrame([(1, "alpha zeta"), (2, "theta eta delta beta"), (3, "absent"), (4, "newword title")], "query_id long, query_text string")
    lexical.build_index(papers_of(spark, list(corpus.values())), path)
    for step in range(3):
        page = [(k, "title", text_of(rng) + (" newword" if k % 2 else "")) for k in rng.sample(range(90), 12)]
        gone = [] if step == 0 else [k for k in rng.sample(sorted(corpus), 4) if k not in {p[0] for p in page}]
        lexical.update_index(spark, path, papers_of(spark, page), spark.createDataFrame([(k,) for k in gone], "paper_id long") if gone else None)
        corpus = {k: v for k, v in corpus.items() if k not in gone} | {p[0]: p for p in page}
    whole = papers_of(spark, list(corpus.values()))
    expected = ranked(lexical.bm25(whole, queries, 10))
    index = lexical.open_index(spark, path)
    assert ranked(lexical.search_index(index, queries, 10)) == expected
    count = lambda: sorted(map(tuple, lexical.open_index(spark, path).terms.collect()))
    terms = count()
    assert terms == sorted(map(tuple, lexical.postings(whole).groupBy("term").agg(F.count("*").alias("df")).collect()))
    assert not lexical.compact_index(spark, path) and lexical.compact_index(spark, path, 1)
    after = lexical.open_index(spark, path)
    assert ranked(lexical.search_index(after, queries, 10)) == expected and count() == terms
    assert after.gone.count() == 0 and after.postings.count() == lexical.postings(whole).count()
    assert ranked(lexical.search_index(index, queries, 10)) == expected  # a reader of the older list isn't cut off


def test_a_page_alone_is_parsed(spark):
    path = scratch(spark, "index")
    lexical.build_index(papers_of(spark, [(1, "a", "alpha beta"), (2, "b", "beta")]), path)
    lexical.update_index(spark, path, papers_of(spark, [(2, "b", "gamma"), (2, "a", "delta")]))
    index = lexical.open_index(spark, path)
    assert {tuple(r) for r in index.postings.select("term", "paper_id").collect()} == {("alpha", 1), ("beta", 1), ("beta", 2), ("delta", 2)}
    assert {r.paper_id for r in index.gone.collect()} == {2} and index.stats.first().n == 2


def test_terms_and_buckets_reach_the_scan(spark, capsys):
    path = scratch(spark, "index")
    lexical.build_index(papers_of(spark, [(k, "t", text_of(random.Random(k))) for k in range(40)]), path)
    queries = spark.createDataFrame([(1, "zeta eta")], "query_id long, query_text string")
    lexical.search_index(lexical.open_index(spark, path), queries, 3).explain("formatted")
    plan = capsys.readouterr().out
    assert "bucket#" in plan and "In(term, [" in plan and "PartitionFilters: [bucket" in plan


def zipfian(rng, size):
    return " ".join(f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in (min(675, int(rng.paretovariate(0.7)) - 1) for _ in range(size)))


@pytest.mark.parametrize("segments", [1, 3])
def test_bounds_of_blocks_lose_no_paper(spark, segments):
    rng, path = random.Random(segments), scratch(spark, "index")
    rows = [(k * 37, "t", zipfian(rng, rng.randrange(1, 60))) for k in range(1500)]
    lexical.build_index(papers_of(spark, rows[:1000]), path)
    for step in range(1, segments):
        page = [(k * 37, "t", zipfian(rng, 20)) for k in range(step * 10, step * 10 + 30)]
        lexical.update_index(spark, path, papers_of(spark, page + rows[500 + 500 * step : 1000 + 500 * step]))
    index = lexical.open_index(spark, path)
    texts = [zipfian(rng, rng.randrange(1, 9)) for _ in range(25)] + ["waa", "waa waa t", "t", "nowhere", "", "waa nowhere " + zipfian(rng, 40)]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")
    few = spark.createDataFrame([(37 * k,) for k in range(0, 1500, 3)], "paper_id long")
    for top, allowed in ((1, None), (10, None), (10, few), (5000, None)):
        assert ranked(lexical.search_best(index, queries, top, allowed)) == ranked(lexical.search_index(index, queries, top, allowed))


def test_bounds_of_blocks_spare_most_weights(spark):
    rng, path = random.Random(9), scratch(spark, "index")
    lexical.build_index(papers_of(spark, [(k, "t", zipfian(rng, 40)) for k in range(6000)]), path)
    index = lexical.open_index(spark, path)
    queries = spark.createDataFrame([(k, f"waa wab wac wad wae wm{chr(97 + k)}") for k in range(12)], "query_id long, query_text string")
    found, probed = lexical.pruned_weights(index, queries, 10)
    every = index.postings.join(lexical.query_terms(queries), "term").count()
    assert found.count() + probed.count() < every / 4
    assert ranked(lexical.search_best(index, queries, 10)) == ranked(lexical.search_index(index, queries, 10))


@pytest.mark.parametrize("kind", ["hybrid", "blended", "reranked"])
def test_many_searches_equal_single_ones(spark, kind):
    if kind == "hybrid":
        options = search.SearchOptions(limit=12)
    elif kind == "blended":
        options = search.SearchOptions(limit=9, hybrid=False, weights={"recency": 0.3, "code": 0.1})
    else:
        options = search.SearchOptions(limit=8, rerank=F.length("abstract"), rerank_depth=5)
    rng = random.Random(8)
    rows = [(k, f"2024-{1 + k % 12:02d}-{1 + k % 28:02d} 0{k % 10}:30:00", "t", text_of(rng), None if k % 3 else "https://code") for k in range(90)]
    papers = spark.createDataFrame(rows, "paper_id long, at string, title string, abstract string, code_url string").withColumn("published_utc", F.col("at").cast("timestamp_ntz")).drop("at")
    tags = spark.createDataFrame([(k, c) for k in range(90) for c in {f"c{k % 4}", f"c{k % 7}"}], "paper_id long, category string")
    signals = spark.createDataFrame([(k, k * 7 % 400) for k in range(0, 90, 2)], "paper_id long, citation_count int")
    vector = {k: [rng.gauss(0, 1) for _ in range(6)] for k in range(70)}
    embeddings = spark.createDataFrame([(k, v) for k, v in vector.items()] + [(80, None)], "paper_id long, vector array<float>")
    plans = [filters.Plan("alpha theta"), filters.Plan("zeta eta", ("c1", "c5"), 200, True), filters.Plan("beta", date_window_days=90), filters.Plan("", ("none",)), filters.Plan("gamma delta", ("c2",)), filters.Plan("theta", (), 0, True)]
    own = [[1], [2, 3, 4], [5, 6], [7], [8, 9], [10]]
    known = [11, None, 12, 13, 14, None]
    many = spark.createDataFrame([(k, p.anchor_text, list(p.categories) or None, p.date_window_days, p.require_no_code) for k, p in enumerate(plans)], "query_id long, anchor_text string, categories array<string>, date_window_days int, require_no_code boolean")
    anchors = [(k, 0 if i == 0 else 1, vector[a]) for k, ids in enumerate(own) for i, a in enumerate(ids)] + [(k, 2, vector[e]) for k, e in enumerate(known) if e is not None]
    found = search.search_many(papers, tags, signals, embeddings, many, spark.createDataFrame(anchors, "query_id long, kind int, vector array<float>"), AS_OF, options)
    got = sorted((r.query_id, r["rank"], r.paper_id, round(r.score, 9), r.is_wildcard, r.proximity) for r in found.collect())
    expected = []
    for k in (0, 1, 2, 3):
        e = known[k]
        one = search.search(papers, tags, signals, embeddings, plans[k], [vector[a] for a in own[k]], AS_OF, None if e is None else vector[e], options)
        expected += [(k, r["rank"], r.paper_id, round(r.score, 9), r.is_wildcard, r.proximity) for r in one.collect()]
    assert [r for r in got if r[0] <= 3] == sorted(expected)
    assert {r[0] for r in got} == {0, 1, 2, 4, 5}


def test_stored_vectors_are_scanned_as_they_are(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(5)], k, False, ["a"]) for k in range(40)], "paper_id long, vector array<float>, published_us long, coded boolean, categories array<string>")
    from lectern.functions import vectors

    stored = rows.select("paper_id", vectors.int8_values(F.col("vector")).alias("q"), vectors.int8_scale(F.col("vector")).alias("scale"), "published_us", "coded", "categories")
    searches = spark.createDataFrame([(k, [0, 2], [[1.0, 0.5, float(k), 0.0, 0.0], [0.0, 1.0, 1.0, 1.0, float(k)]], 5, False, None) for k in range(5)], "query_id long, kinds array<int>, anchors array<array<float>>, since_us long, no_code boolean, wanted array<string>")
    both = [sorted(map(tuple, dense_many.top_many(r, searches, 7, 16, 2).collect())) for r in (rows, stored)]
    assert both[0] == both[1] and len(both[0]) == 35 and min(r[1] for r in both[0]) >= 5


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_stored_blocks_give_the_same_best(spark, spread):
    rng, path = random.Random(4), scratch(spark, "vectors")
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, [x + rng.gauss(0, spread) for x in centers[k % 6]]) for k in range(400)] + [(k + 400, centers[0]) for k in range(5)] + [(900, None), (901, [0.0] * 8)]
    embeddings = spark.createDataFrame(rows, "paper_id long, vector array<float>")
    assert vector_table.current(spark, path) is None
    blocks = vector_table.write(embeddings, path, "model a", block=16)
    assert sorted(map(tuple, dense.scores(vector_table.rows(blocks), [centers[1]]).collect())) == sorted(map(tuple, dense.scores(embeddings, [centers[1]]).collect()))
    for anchors in ([centers[0]], [centers[1], centers[2], rows[7][1]]):
        got = [(r.paper_id, r["rank"], round(r.score, 9), round(r.best, 9)) for r in vector_table.top(blocks, anchors, 20).orderBy("rank").collect()]
        every = dense.top(dense.anchor_scores(embeddings, anchors), 20)
        assert got == [(r.paper_id, r["rank"], round(r.score, 9), round(r.best, 9)) for r in every.orderBy("rank").collect()]
    vector_table.write(embeddings.where("paper_id < 3"), path, "model/b")
    model, now = vector_table.current(spark, path)
    assert model == "model/b" and vector_table.rows(now).count() == 3 and vector_table.rows(blocks).count() == 406
