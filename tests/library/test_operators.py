import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import dense, dml, filters, lexical, ranking
from lectern.operators.filters import Plan
from lectern.plans import accounts, browse, evaluation, telemetry

AS_OF = "2024-12-31 00:00:00"


@pytest.fixture(scope="module")
def papers(spark):
    rows = [(1, "t1", "a1", "en", "2024-12-30 10:00:00", None), (2, "t2", "a2", "en", "2024-12-21 10:00:00", "https://github.com/a/b"), (3, "t3", "a3", "fr", "2024-12-26 00:00:00", None)]
    return spark.createDataFrame(rows, "paper_id long, title string, abstract string, primary_category string, p string, code_url string").withColumn("published_utc", F.col("p").cast("timestamp_ntz")).drop("p")


@pytest.fixture(scope="module")
def categories(spark):
    return spark.createDataFrame([(1, "en"), (2, "en"), (2, "sec"), (3, "sec")], "paper_id long, category string")


def ids(df):
    return sorted(r.paper_id for r in df.collect())


def test_filters(spark, papers, categories):
    assert ids(filters.any_category(papers, categories, [])) == [1, 2, 3]
    assert ids(filters.any_category(papers, categories, ["sec", "none"])) == [2, 3]
    assert ids(filters.any_category(papers, categories, ["none"])) == []
    assert ids(filters.in_window(papers, 5, AS_OF)) == [1, 3] and ids(filters.in_window(papers, 0, AS_OF)) == [1, 2, 3]
    later = "2024-12-31 00:00:01"
    assert ids(filters.in_window(papers, 5, later)) == [1] and ids(filters.in_window_days(papers, 5, later)) == [1, 3]
    assert ids(filters.candidates(papers, categories, Plan(categories=("sec",), require_no_code=True), AS_OF)) == [3]
    assert ids(filters.index_gate(papers, categories, Plan(date_window_days=5), later)) == [1, 3]
    owned = spark.createDataFrame([(1, 1), (None, 2)], "user_id long, paper_id long")
    assert ids(filters.owned_by(owned, papers, 1)) == [1] and ids(filters.owned_by(owned, papers, None)) == [2]
    with pytest.raises(ValueError):
        filters.checked_page(0, 10)
    with pytest.raises(ValueError):
        browse.browse(papers, categories, as_of=AS_OF, sort="nope")
    assert filters.checked_limit(1000) == 200 and ranking.pool_size(10) == 60 and ranking.pool_size(50) == 250


def test_bm25_by_hand(spark, papers):
    docs = spark.createDataFrame([(1, "aa", "bb bb"), (2, "aa", "cc"), (3, "dd", "dd")], "paper_id long, title string, abstract string").withColumn("published_utc", F.lit("2024-01-01").cast("timestamp_ntz"))
    queries = spark.createDataFrame([(9, "bb aa aa"), (8, "zz")], "query_id long, query_text string")
    rows = lexical.bm25(docs, queries, 10).collect()
    avg = 7 / 3

    def w(df, tf, dl):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert {(r.query_id, r.paper_id, r.rank): pytest.approx(r.score) for r in rows} == {(9, 1, 1): w(2, 1, 3) + w(1, 2, 3), (9, 2, 2): w(2, 1, 2)}


def test_fusion_and_wildcards(spark):
    dense = spark.createDataFrame([(21, 0.71, 1), (22, 0.66, 2), (23, 0.5, 3)], "paper_id long, score double, rank int")
    words = spark.createDataFrame([(24, 1), (23, 2)], "paper_id long, rank int")
    best = spark.createDataFrame([(24, 0.31)], "paper_id long, best double")
    rows = ranking.fuse(dense, words, best, 10).orderBy("rank").collect()
    assert [r.paper_id for r in rows] == [23, 21, 24, 22] and [r.score for r in rows] == [0.5, 0.71, 0.31, 0.66]
    pool = spark.createDataFrame([(100 + k, 0.9 - k / 50, k) for k in range(1, 14)], "paper_id long, score double, rank int")
    known = lambda pairs: spark.createDataFrame(pairs, "paper_id long, score double")
    pick = lambda e, limit=6: [r.paper_id - 100 for r in ranking.select_slots(pool, limit, e).orderBy("rank").collect()]
    assert pick(known([(100 + k, 0.6) for k in (5, 6, 7, 9, 10, 12)] + [(113, 0.02), (108, -0.1), (111, 0.3)])) == [1, 2, 3, 4, 8, 13]
    assert pick(known([(112, 0.2)])) == [1, 2, 3, 4, 12, 5]
    assert pick(None) == [1, 2, 3, 4, 5, 6] and pick(known([(112, 0.2)]), 2) == [1, 2] and pick(known([(112, 0.2)]), 13) == list(range(1, 14))


def test_team_draft():
    first, second = (lambda n: True), (lambda n: False)
    assert ranking.interleaved([7, 8, 9], [8, 5, 6, 4], 6, first) == [(7, "A"), (8, "B"), (9, "A"), (5, "B"), (6, "B"), (4, "B")]
    assert ranking.interleaved([7, 8, 9], [8, 5, 6, 4], 3, second) == [(8, "B"), (7, "A"), (5, "B")]
    assert ranking.interleaved([], [3], 2, first) == [(3, "B")] and ranking.interleaved([], [], 2, first) == []
    assert ranking.interleaved([2, 2, 1], [2, 1, 1], 5, first) == [(2, "A"), (1, "B")]
    heads = sum(ranking.coin(s, t, 1) for s in range(60) for t in range(20))
    assert 500 < heads < 700 and ranking.coin(4, 2, 1) == ranking.coin(4, 2, 1)


def test_ranks_spread_over_tasks(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 10 else f"g{k % 3}", (k * 37) % 101) for k in range(3000)], "id long, g string, v int").repartition(5)
    found = ranking.ranks(rows, ["g"], [F.desc("v"), F.asc("id")]).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.g, []).append(r)
    for own in groups.values():
        ordered = sorted(own, key=lambda r: (-r.v, r.id))
        assert [r.rank for r in ordered] == list(range(1, len(own) + 1)) and {r.size for r in own} == {len(own)}
    assert len(found) == 3000 and [r.rank for r in ranking.ranks(rows.limit(0), [], ["id"]).collect()] == []
    assert sorted((r.id, r.rank) for r in ranking.ranks(rows, [], ["id"]).collect()) == [(k, k + 1) for k in range(3000)]


def ranked(spark, letters, grades):
    rows = spark.createDataFrame([("q", ord(c), k + 1) for k, c in enumerate(letters)], "query_id string, paper_id long, rank int")
    judged = spark.createDataFrame([("q", ord(c), g, "pool") for c, g in grades.items()], "query_id string, paper_id long, grade int, source string")
    return rows, judged


def test_metrics_by_hand(spark):
    m = evaluation.metrics(*ranked(spark, "PQRST", {"T": 3, "Q": 1, "P": 2, "Z": 1}), k=5).first()
    gain = 3 + 1 / math.log2(3) + 7 / math.log2(6)
    assert m.ndcg == pytest.approx(gain / (7 + 3 / math.log2(3) + 1 / 2 + 1 / math.log2(5)))
    assert (m.recall, m.reciprocal_rank, m.judged_at_k, m.judged, m.relevant) == (1.0, 1.0, 3, 4, 2)
    none = evaluation.metrics(*ranked(spark, "PQ", {"Z": 0, "P": 0})).first()
    assert none.ndcg is None and none.recall is None and none.reciprocal_rank is None
    some = {"W": 2, "Q": 3, "S": 2, "P": 1, "T": 2}
    assert evaluation.metrics(*ranked(spark, "PQRSTU", some), depth=2).first().recall == pytest.approx(1 / 4)
    assert evaluation.metrics(*ranked(spark, "PQRSTU", some), depth=6).first().recall == pytest.approx(3 / 4)
    assert evaluation.metrics(*ranked(spark, "UVRS", some)).first().reciprocal_rank == pytest.approx(1 / 4)
    assert evaluation.metrics(*ranked(spark, "UV", some)).first().reciprocal_rank == 0
    assert not evaluation.passes(evaluation.metrics(*ranked(spark, "UVRS", some)), 0.59).first().passed


def test_repeated_judgments_and_wildcards(spark):
    rows, judged = ranked(spark, "AB", {"A": 3, "B": 0})
    again = spark.createDataFrame([("q", ord("A"), 3, "random"), ("q", ord("B"), 2, "random")], judged.schema)
    twice, once = (evaluation.metrics(rows, j).first() for j in (judged.unionByName(again), judged))
    assert twice == once and once.ndcg == 1.0 and (once.judged, once.relevant) == (2, 1)
    wild = rows.withColumn("is_wildcard", F.col("rank") == 1)
    assert evaluation.metrics(wild, judged).first().ndcg == 0.0
    assert evaluation.metrics(wild, judged.where("grade = 0").unionByName(again.where(f"paper_id = {ord('A')}"))).first().reciprocal_rank == 0.0
    assert evaluation.metrics(rows.unionByName(rows.withColumn("rank", F.col("rank") + 5)), judged).first() == once


def pairs(spark, cells):
    return spark.createDataFrame([(n, o, c) for n, (o, c) in enumerate(cells)], "paper_id long, orig int, cal int")


def test_kappa(spark):
    kappa = lambda cells: evaluation.weighted_kappa(pairs(spark, cells)).first().kappa
    assert kappa([(g, g) for g in range(4) for _ in range(10)]) == pytest.approx(1)
    assert kappa([(a, b) for a in range(4) for b in range(4)]) == pytest.approx(0)
    assert kappa([]) == 0 and kappa([(1, 1)]) == 1
    assert kappa([(0, 1), (3, 3), (0, 0)]) > kappa([(0, 3), (3, 3), (0, 0)])


def test_category_scores(spark):
    rows = spark.createDataFrame([("a", ["X"], ["x", "y"], ["z"]), ("b", [], ["x"], None), ("c", ["q"], [], None), ("d", ["q"], ["x"], None)], "query_id string, emitted array<string>, expected array<string>, acceptable array<string>")
    found = {r.query_id: (r.precision, r.recall, r.f1) for r in evaluation.category_scores(rows).collect()}
    assert found["a"] == (1.0, 0.5, pytest.approx(2 / 3)) and found["b"] == (1.0, 0.0, 0.0) and found["c"] == (0.0, 1.0, 0.0) and found["d"] == (0.0, 0.0, 0.0)


def test_verdicts(spark):
    raw = spark.createDataFrame([(1, '[{"id":"a","grade":9},{"id":"a","grade":1},{"id":"zz","grade":2},{"id":"b","grade":-4}]'), (2, "broken")], "batch_id int, answer string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "batch_id int, id string")
    assert sorted((r.id, r.grade) for r in evaluation.verdicts(raw, asked).collect()) == [("a", 3), ("b", 0)]


def test_upserts(spark):
    table = spark.createDataFrame([("a", 1, None), ("b", 1, "x")], "k string, v int, seen string")
    page = spark.createDataFrame([("a", 1, "n"), ("b", 2, "n"), ("c", 3, "n")], "k string, v int, seen string")
    assert sorted((r.k, r.change) for r in dml.upsert_diff(table, page, "k", ["v"]).collect()) == [("a", "same"), ("b", "updated"), ("c", "added")]
    after = dml.upsert(table, page, "k", kept=["seen"])
    assert sorted((r.k, r.v, r.seen) for r in after.collect()) == [("a", 1, "n"), ("b", 2, "x"), ("c", 3, "n")]
    assert {r.change for r in dml.upsert_diff(after, page, "k", ["v"]).collect()} == {"same"}
    profiles = spark.createDataFrame([(1, 3)], "user_id long, version int")
    assert sorted(tuple(r) for r in dml.saved_profile(profiles, spark.createDataFrame([(1, 0), (2, 0)], "user_id long, version int")).collect()) == [(1, 4), (2, 1)]


def test_a_page_that_repeats_a_key(spark):
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    page = spark.createDataFrame([("a", 3, 2), ("a", 2, 1), ("b", 9, 3), ("b", 9, 4)], "k string, v int, at int")
    assert sorted(tuple(r) for r in dml.upsert(table, page, "k", position=["at"]).collect()) == [("a", 2), ("b", 9)]
    assert sorted(tuple(r) for r in dml.add_only(table, page.select("k", "v"), "k").collect()) == [("b", 9)]
    changes = dml.upsert_diff(table, page, "k", ["v"], ["at"])
    assert sorted(tuple(r) for r in changes.collect()) == [("a", "updated"), ("b", "added")]
    assert tuple(dml.updated_counts(changes).first()) == (2, 1, 1)


def test_nearest_in_blocks(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(230)]
    frame = spark.createDataFrame(rows, "paper_id long, vector array<float>").repartition(3)
    asked = frame.where("paper_id % 20 = 0").withColumnRenamed("paper_id", "query_id")
    found = dense.nearest(frame, asked, 5, block=16)
    every = dense.scores(frame, [rows[40][1]]).orderBy(F.desc(F.round("cosine", 9)), "paper_id").limit(5).collect()
    assert [r.paper_id for r in found.where("query_id = 40").orderBy("rank").collect()] == [r.paper_id for r in every]
    assert found.count() == 12 * 5


def test_stored_index_agrees_with_parsed_text(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, "t", " ".join(rng.choices("aa bb cc dd ee ff gg".split(), k=rng.randrange(0, 9)))) for k in range(60)], "paper_id long, title string, abstract string").withColumn("published_utc", F.lit("2024-01-01").cast("timestamp_ntz"))
    queries = spark.createDataFrame([(1, "aa bb"), (2, "gg zz"), (3, "")], "query_id long, query_text string")
    path = str(tmp_path / "index")
    assert lexical.open_index(spark, path) is None
    lexical.build_index(docs, path)
    rows = lambda df: sorted((r.query_id, r.paper_id, r.rank, round(r.score, 9)) for r in df.collect())
    allowed = docs.where("paper_id % 2 = 0")
    assert rows(lexical.search_index(lexical.open_index(spark, path), queries, 10)) == rows(lexical.bm25(docs, queries, 10))
    assert rows(lexical.search_index(lexical.open_index(spark, path), queries, None, allowed)) == rows(lexical.bm25(docs, queries, None, allowed))


def test_ledger(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    grants = spark.createDataFrame([(1, 100), (1, 50)], "user_id long, amount_micros long")
    usage = spark.createDataFrame([(1, 170, False, "2024-12-31 01:00:00"), (1, 999, True, "2024-12-31 01:00:00")], "user_id long, cost_micros long, used_byo_key boolean, t string").withColumn("created_utc", F.col("t").cast("timestamp_ntz"))
    balance = accounts.balances(users, grants, usage)
    assert {r.user_id: (r.granted, r.spent, r.remaining) for r in balance.collect()} == {1: (150, 170, 0), 2: (0, 0, 0)}
    assert {r.verdict for r in accounts.gate(balance, accounts.daily_calls(usage, "2024-12-31 05:00:00"), 1).collect()} == {"daily_cap", "no_budget"}


def test_empty_head_gives_nulls(spark):
    head = spark.createDataFrame([], "is_wildcard boolean, proximity string")
    assert telemetry.comfort_zone(head).first().close_percent is None


def test_adopted_ids(spark):
    logged = spark.createDataFrame([("A b", "p1", 1), (" a  B ", "p2", 2), ("a-b", "p3", 3), ("", "p4", 4)], "query_text string, plan string, created long")
    rows = {r.query_id: (r.query_text, r.plan, r.uses) for r in telemetry.adopt(logged).collect()}
    assert rows == {"adopted-a-b": (" a  B ", "p2", 2), "adopted-a-b-2": ("a-b", "p3", 1)}


def test_invites(spark):
    from lectern.plans import workflow

    invites = spark.createDataFrame([("a", 0, 1, None), ("b", 1, 1, None), ("c", 0, 1, "2024-01-01 00:00:00")], "code string, used int, max_uses int, e string").withColumn("expires_utc", F.col("e").cast("timestamp_ntz"))
    users = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "user_id long, is_active boolean")
    claims = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "user_id long, code string")
    used, active = workflow.redeemed(invites, users, claims, AS_OF)
    assert {r.code: r.used for r in used.collect()} == {"a": 1, "b": 1, "c": 0}
    assert sorted(r.user_id for r in active.where("is_active").collect()) == [1, 3]
