"""Registered queries: searches over many vectors, functions, model contracts, accounts, runs and embeddings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import dates, jsons, text, vectors
from lectern.operators import dense, dml, filters, lexical, ranking, vector_table
from lectern.plans import accounts, evaluation, runs, search, workflow
from lectern.queries import _COS, _DRAFT, _LEX_ONE, _QUANT, _TERMS, ANCHORS, _anchors, query
from lectern.queries_reports import _METRICS, _RUNS, _item_judgments, _runs
from lectern.sources import connectors
from lectern.sources.artifacts import publish, published
from lectern.streaming import ingest
from lectern.streaming.queue import WorkQueue
from lectern.tables import scratch
from lectern.views import AS_OF, Corpus

# Searches


@query(f"""WITH {_QUANT}, cx AS (SELECT a.paper_id AS query_id, d.paper_id, round(CAST(list_sum(list_transform(list_zip(d.q, a.q), lambda z: z[1] * z[2])) AS DOUBLE) * CAST(a.scale AS DOUBLE) * CAST(d.scale AS DOUBLE), 9) AS cosine FROM q8 a, q8 d WHERE a.paper_id % 20 = 0)
SELECT query_id, paper_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, paper_id) AS INT) AS rank, round(cosine, 6) AS cosine FROM cx QUALIFY rank <= 10""")
def dense_nearest(c: Corpus) -> DataFrame:
    """The ten nearest of all vectors to every vector whose id is divisible by 20."""
    asked = c.embeddings.where("paper_id % 20 = 0").withColumnRenamed("paper_id", "query_id")
    return dense.nearest(c.embeddings, asked, 10, 512).select("query_id", "paper_id", "rank", F.round("cosine", 6).alias("cosine"))


_PROSE = "thstin and eralle of onnthe"
_YEAR = f"SELECT paper_id FROM papers WHERE CAST(published_utc AS DATE) >= CAST(TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AS DATE)"


@query(f"WITH {_TERMS}, {_COS}, {_LEX_ONE.format(repr(_PROSE), _YEAR)} SELECT CAST(rank AS INT) AS rank, paper_id, round(score, 6) AS score FROM fr WHERE rank <= 50")
def quick_search(c: Corpus) -> DataFrame:
    found = search.quick_search(c.papers, c.paper_categories, c.signals, c.embeddings, _PROSE, _anchors(c, ANCHORS), AS_OF, search.SearchOptions(limit=50, index=c.lexicon))
    return found.select("rank", "paper_id", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {_TERMS}, {_COS}, {_LEX_ONE.format(repr(_PROSE), _YEAR)}, ls AS (SELECT CAST(17 AS BIGINT) AS search_id, (SELECT list(paper_id ORDER BY d) FROM dn WHERE d <= 50) AS pa, (SELECT list(paper_id ORDER BY rank) FROM fr WHERE rank <= 50) AS pb), {_DRAFT.format(3, 50).replace('SELECT search_id, CAST(i AS INT) AS rank', 'SELECT CAST(i AS INT) AS rank')}")
def interleaved_search(c: Corpus) -> DataFrame:
    """Two real searches of one request: vectors alone against vectors and words."""
    run = lambda hybrid: search.quick_search(c.papers, c.paper_categories, c.signals, c.embeddings, _PROSE, _anchors(c, ANCHORS), AS_OF, search.SearchOptions(limit=50, hybrid=hybrid, index=c.lexicon))
    return search.interleaved_search(run(False), run(True), 17, 50, seed=3)


def _plans(c: Corpus) -> DataFrame:
    """A plan for every benchmark item whose id is divisible by 20; every other one has all filters, every fourth a window alone."""
    item, some = F.col("item_id"), F.col("item_id") % 40 == 0
    days = F.when(some, 200).when(item % 80 == 20, 120).cast("int")
    wanted = F.when(some, F.array(F.lit("en"), F.lit("fr")))
    return c.table("benchmark").where(item % 20 == 0).select(item.alias("query_id"), F.col("text").alias("anchor_text"), wanted.alias("categories"), days.alias("date_window_days"), some.alias("require_no_code"))


def _plan_anchors(c: Corpus) -> DataFrame:
    """Each plan's primary vector, two topics, and an experience unless its id is divisible by 60."""
    of = F.explode(F.array(*(F.struct((F.col("query_id") + k).alias("paper_id"), F.lit(kind).alias("kind")) for k, kind in ((7, 0), (11, 1), (13, 1), (5, 2))))).alias("x")
    rows = _plans(c).select("query_id", of).select("query_id", "x.*").where("kind < 2 or query_id % 60 <> 0")
    return rows.join(c.embeddings, "paper_id").select("query_id", "kind", "vector")


_MANY = _TERMS + f""",
qs AS (SELECT item_id AS query_id, text, CASE WHEN item_id % 40 = 0 THEN 200 WHEN item_id % 80 = 20 THEN 120 END AS days, item_id % 40 = 0 AS gated FROM benchmark WHERE item_id % 20 = 0),
al AS (SELECT query_id, paper_id FROM qs, papers WHERE CASE WHEN gated THEN code_url IS NULL AND published_utc >= TIMESTAMP '{AS_OF}' - INTERVAL 200 DAY AND paper_id IN (SELECT paper_id FROM paper_categories WHERE category IN ('en', 'fr'))
  WHEN days IS NOT NULL THEN CAST(published_utc AS DATE) >= CAST(TIMESTAMP '{AS_OF}' - INTERVAL 120 DAY AS DATE) ELSE true END),
{_QUANT},
an AS (SELECT query_id, query_id + k AS anchor, kind FROM qs, (SELECT unnest([7, 11, 13, 5]) AS k, unnest(['p', 't', 't', 'e']) AS kind) WHERE kind <> 'e' OR query_id % 60 <> 0),
cs AS (SELECT an.query_id, kind, d.paper_id, CAST(list_sum(list_transform(list_zip(d.q, a.q), lambda z: z[1] * z[2])) AS DOUBLE) * CAST(d.scale AS DOUBLE) * CAST(a.scale AS DOUBLE) AS cosine FROM an JOIN q8 a ON a.paper_id = an.anchor, q8 d),
ma AS (SELECT query_id, paper_id, (max(cosine) FILTER (WHERE kind = 'p') + max(cosine) FILTER (WHERE kind = 't')) / 2 AS score, max(cosine) FILTER (WHERE kind <> 'e') AS best, max(cosine) FILTER (WHERE kind = 'e') AS e FROM cs JOIN al USING (query_id, paper_id) GROUP BY 1, 2),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]{{2,}}')) AS term FROM qs),
sc AS (SELECT qt.query_id, tf.paper_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN docs USING (paper_id), st GROUP BY 1, 2),
lx AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) AS l FROM sc JOIN al USING (query_id, paper_id) QUALIFY l <= 250),
dn AS (SELECT query_id, paper_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) AS d FROM ma QUALIFY d <= 250),
fr AS (SELECT coalesce(dn.query_id, lx.query_id) AS query_id, coalesce(dn.paper_id, lx.paper_id) AS paper_id, dn.score AS s, row_number() OVER (PARTITION BY coalesce(dn.query_id, lx.query_id) ORDER BY round(coalesce(1.0 / (60 + d), 0) + coalesce(1.0 / (60 + l), 0), 12) DESC, d NULLS LAST, l) AS rank
  FROM dn FULL JOIN lx ON dn.query_id = lx.query_id AND dn.paper_id = lx.paper_id QUALIFY rank <= 250),
fu AS (SELECT fr.query_id, fr.paper_id, coalesce(s, best, 0.0) AS score, rank, e, fr.query_id % 60 <> 0 AS known, count(*) OVER (PARTITION BY fr.query_id) AS size FROM fr LEFT JOIN ma ON ma.query_id = fr.query_id AND ma.paper_id = fr.paper_id),
sl AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank <= 48 ORDER BY round(e, 9) NULLS LAST, rank) AS w FROM fu),
ch AS (SELECT query_id, paper_id, score, e, known, CASE WHEN known AND size > 50 AND rank > 48 THEN 48 + w ELSE rank END AS rank, known AND size > 50 AND rank > 48 AS is_wildcard FROM sl WHERE CASE WHEN known AND size > 50 THEN rank <= 48 OR w <= 2 ELSE rank <= 50 END)"""


def _search_many(c: Corpus) -> DataFrame:
    return search.search_many(c.papers, c.paper_categories, c.signals, vector_table.rows(c.vectors), _plans(c), _plan_anchors(c), AS_OF, search.SearchOptions(limit=50, index=c.lexicon))


@query(f"WITH {_MANY} SELECT query_id, CAST(rank AS INT) AS rank, paper_id, round(score, 6) AS score, is_wildcard, CASE WHEN e >= 0.45 THEN 'close' WHEN e < 0.25 THEN 'stretch' END AS proximity FROM ch")
def search_many(c: Corpus) -> DataFrame:
    return _search_many(c).select("query_id", "rank", "paper_id", F.round("score", 6).alias("score"), "is_wildcard", "proximity")


_GATE = _METRICS[_METRICS.index("ga AS") :].replace("FROM rk LEFT JOIN gj USING (query_id, paper_id) WHERE rank <= 50", "FROM (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ch WHERE NOT is_wildcard) rk LEFT JOIN gj USING (query_id, paper_id) WHERE rank <= 50").replace("b.item_id = l.doc_id % 40", "b.item_id = l.doc_id % 40 AND b.item_id % 20 = 0")


@query(f"WITH {_MANY}, {_GATE} SELECT round(avg(ndcg), 6) AS mean_ndcg, coalesce(avg(ndcg), 0) >= 0.01 AS passed FROM mt")
def search_gate(c: Corpus) -> DataFrame:
    """The gate of a build, on real searches: wildcards don't count, the papers behind them move up."""
    judged = _item_judgments(c).where("query_id % 20 = 0")
    return evaluation.passes(evaluation.metrics(_search_many(c), judged), 0.01).select(F.round("mean_ndcg", 6).alias("mean_ndcg"), "passed")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%er#00000001%' OR lower(c_mktsegment) LIKE '%build%'")
def text_search(c: Corpus) -> DataFrame:
    rows = c.table("customer")
    return filters.text_search(rows, "er#00000001", "c_name").unionByName(filters.text_search(rows, "BUILD", "c_mktsegment")).select("c_custkey", "c_name").distinct()


@query("SELECT paper_id, CAST(row_number() OVER (ORDER BY coalesce(composite_score, -1) DESC, (paper_id % 100) DESC, paper_id) AS INT) AS rank FROM papers LEFT JOIN (SELECT paper_id, composite_score FROM analyses) USING (paper_id)")
def client_score_order(c: Corpus) -> DataFrame:
    rows = c.papers.select("paper_id", (F.col("paper_id") % 100).cast("double").alias("score")).join(c.analyses.select("paper_id", "composite_score"), "paper_id", "left")
    return ranking.ranks(rows, [], workflow.by_score(rows)).select("paper_id", "rank")


@query("SELECT p.paper_id, CAST(i.k AS INT) AS position FROM (SELECT unnest([40, 7, 6, 12, 3]) AS id, unnest([0, 1, 2, 3, 5]) AS k) i JOIN papers p ON p.paper_id = i.id WHERE p.paper_id NOT IN (SELECT paper_id FROM analyses WHERE user_id = 1 AND schema_version >= 2 AND profile_version = 1)")
def stale_selection_of_list(c: Corpus) -> DataFrame:
    return workflow.stale_selection(c.papers, c.paper_categories, c.analyses, 1, 1, AS_OF, ids=[40, 7, 6, 12, 7, 3]).select("paper_id", "position")


# Functions


@query("SELECT item_id, concat('query: ', text) AS asked FROM benchmark")
def prefixed_query(c: Corpus) -> DataFrame:
    return c.table("benchmark").select("item_id", workflow.prefixed_query(F.col("text"), "query: ").alias("asked"))


@query("""SELECT DISTINCT concat(lang, '.', source) AS code, CASE WHEN lang = 'en' AND source = 'src1' THEN 'Own name' WHEN lang = 'en' AND source = 'src2' THEN 'English of two' WHEN lang = 'en' THEN 'English' WHEN lang = 'fr' THEN 'French' ELSE concat(lang, '.', source) END AS name FROM documents""")
def category_names(c: Corpus) -> DataFrame:
    codes = c.documents.select(F.concat_ws(".", "lang", "source").alias("code")).distinct()
    stored = c.spark.createDataFrame([("en.src1", "Own name"), ("en.src3", "en.src3")], "code string, name string")
    taxonomy = c.spark.createDataFrame([("en", "English"), ("fr", "French"), ("en.src2", "English of two")], "code string, name string")
    return filters.named_categories(codes, stored, taxonomy)


_SPAN = "strftime(published_utc, '%Y%m%d%H%M'), ' TO ', strftime(published_utc + INTERVAL 30 DAY, '%Y%m%d%H%M')"


@query(f"SELECT paper_id, concat('http://h/api?search_query=', url_encode(concat('cat:', primary_category, ' AND submittedDate:[', {_SPAN}, ']')), '&start=', CAST(paper_id % 300 AS VARCHAR), '&max_results=100&sortBy=submittedDate&sortOrder=ascending') AS url, concat('http://arxiv.org/abs/', arxiv_id) AS abs_url, concat('http://arxiv.org/pdf/', arxiv_id) AS pdf_url FROM papers")
def service_urls(c: Corpus) -> DataFrame:
    since, until = dates.minute_stamp(F.col("published_utc")), dates.minute_stamp(F.col("published_utc") + F.make_dt_interval(F.lit(30)))
    url = text.query_url("http://h/api", F.col("primary_category"), since, until, F.col("paper_id") % 300, 100)
    return c.papers.select("paper_id", url.alias("url"), text.abs_url(F.col("arxiv_id")).alias("abs_url"), text.pdf_url(F.col("arxiv_id")).alias("pdf_url"))


@query(f"SELECT c_custkey, array_to_string(list_transform(range(8), lambda k: substr('{text.UNAMBIGUOUS}', CAST(concat('0x', substr(sha256(concat('secret ', CAST(c_custkey AS VARCHAR))), CAST(2 * k + 1 AS BIGINT), 2)) AS INT) % 32 + 1, 1)), '') AS code FROM customer")
def invite_codes(c: Corpus) -> DataFrame:
    return c.table("customer").select("c_custkey", text.invite_code(F.concat(F.lit("secret "), F.col("c_custkey").cast("string"))).alias("code"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M') AS minute, strftime(ts, '%Y-%m-%d') AS day, date_trunc('day', ts)::TIMESTAMP + INTERVAL 390 MINUTE + CASE WHEN date_trunc('day', ts)::TIMESTAMP + INTERVAL 390 MINUTE > ts THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS next_run, CASE WHEN event_id % 9 = 0 THEN true ELSE ts < TIMESTAMP '2024-01-05 12:00:00' - INTERVAL 120 MINUTE END AS is_stale FROM events")
def time_functions(c: Corpus) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    taken = F.when(F.col("event_id") % 9 != 0, ts)
    return c.table("events").select("event_id", dates.minute_stamp(ts).alias("minute"), dates.day_stamp(ts).alias("day"), dates.next_daily(ts, 6, 30).alias("next_run"), dates.is_stale(taken, "2024-01-05 12:00:00").alias("is_stale"))


@query("""WITH s AS (SELECT vec_id, embedding AS v, 1 + 2 * (vec_id % 2) - CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS k, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)
SELECT vec_id, round(CASE WHEN k = 0 THEN 0.0 ELSE sign(k) * CAST(v[1] AS DOUBLE) / norm END, 6) AS first, round(CASE WHEN k = 0 THEN 0.0 ELSE sign(k) * list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE))) / norm END, 6) AS total FROM s""")
def mean_pooling(c: Corpus) -> DataFrame:
    """A vector, its double and its negative as tokens, masked by the id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    tokens = F.array(v, F.transform(v, lambda x: x * 2), F.transform(v, lambda x: -x), F.transform(v, lambda x: x * 9))
    mask = F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), (F.col("vec_id") % 3 == 0).cast("int"), F.lit(0))
    rows = c.table("embeddings").select("vec_id", vectors.mean_pooled(tokens, mask).alias("u"))
    return rows.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT event_id, round(((event_id % 1000) * 0.25 + (event_id % 77) * 1.25) / 1000000.0 * (event_id % 50), 9) AS dollars, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(round_even(CAST(least(100, greatest(0, (event_id % 1601) / 8.0 - 20)) AS DOUBLE), 2) AS DOUBLE) END AS score FROM events")
def estimates_and_scores(c: Corpus) -> DataFrame:
    cost = accounts.action_estimate(F.col("event_id") % 1000, F.col("event_id") % 77, F.lit("0.25"), F.lit("1.25"), F.col("event_id") % 50)
    raw = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 1601) / 8.0 - 20)
    return c.table("events").select("event_id", F.round(cost, 9).alias("dollars"), accounts.composite_score(raw).alias("score"))


# JSON contracts


@query("SELECT doc_id, lang AS anchor, concat('[\"', lang, '\",\"', source, '\"]') AS categories, CAST(doc_id % 400 AS INT) AS days FROM documents")
def plan_round_trip(c: Corpus) -> DataFrame:
    plan = F.struct(F.lit("i").alias("interpretation"), F.col("lang").alias("anchorText"), F.array("lang", "source").alias("categories"), (F.col("doc_id") % 400).cast("int").alias("dateWindowDays"), F.lit(False).alias("requireNoCode"))
    raw = c.documents.select("doc_id", jsons.plan_json(plan).alias("j"))
    return raw.select("doc_id", F.get_json_object("j", "$.anchorText").alias("anchor"), F.get_json_object("j", "$.categories").alias("categories"), jsons.plan_of(F.col("j"))["dateWindowDays"].alias("days"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, event_id % 3 <> 0 AS is_empty FROM events")
def open_details(c: Corpus) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit("{broken"))
    rows = c.table("events").select("event_id", jsons.details(raw).alias("d"))
    return rows.select("event_id", F.try_variant_get("d", "$.k", "int").alias("k"), (F.to_json("d") == "{}").alias("is_empty"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN lang IN ('en', 'fr') THEN lang ELSE '' END END AS categories, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 > 0 THEN CAST(doc_id % 5 AS INT) END AS days,
CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN 'precise' END AS intent, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 > 0 THEN 'text' END AS hyde FROM documents""")
def checked_plans(c: Corpus) -> DataFrame:
    """Compiled plans of all kinds: blank anchors, unknown categories, odd spellings, intents outside the list."""
    d = F.col("doc_id")
    raw = F.struct(
        F.lit("i").alias("interpretation"), F.when(d % 7 == 0, F.lit("  ")).otherwise(F.lit("a")).alias("anchorText"), F.array(F.upper("lang"), F.lit("unknown")).alias("categories"), (d % 5).cast("int").alias("dateWindowDays"),
        F.when(d % 3 == 0, F.lit(" ")).otherwise(F.lit("text")).alias("hypotheticalAbstract"), F.when(d % 2 == 0, F.lit(" Precise ")).otherwise(F.lit("adventurous")).alias("intent"),
    )
    plan = jsons.checked_plan(jsons.plan_of(F.to_json(raw)), F.array(F.lit("en"), F.lit("fr")))
    rows = c.documents.select("doc_id", plan.alias("p"))
    return rows.select("doc_id", F.array_join("p.categories", ",").alias("categories"), F.col("p.dateWindowDays").alias("days"), F.col("p.intent").alias("intent"), F.col("p.hypotheticalAbstract").alias("hyde"))


@query("SELECT doc_id // 10 AS batch_id, CAST(doc_id AS VARCHAR) AS id, CAST(least(3, greatest(0, doc_id % 9 - 2)) AS INT) AS grade FROM documents WHERE doc_id % 4 <> 3")
def judge_verdicts(c: Corpus) -> DataFrame:
    """Answers of a judge in batches of ten: grades outside the scale, ids that weren't asked for, and each id twice."""
    row = F.struct(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 9 - 2).cast("int").alias("grade"))
    again = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("grade"))
    answers = c.documents.groupBy(F.floor(F.col("doc_id") / 10).alias("batch_id")).agg(F.array_sort(F.collect_list(row)).alias("a"), F.array_sort(F.collect_list(again)).alias("b"))
    raw = answers.select("batch_id", F.to_json(F.concat("a", "b", F.array(F.struct(F.lit("nobody").alias("id"), F.lit(2).alias("grade"))))).alias("answer"))
    asked = c.documents.where("doc_id % 4 <> 3").select(F.floor(F.col("doc_id") / 10).alias("batch_id"), F.col("doc_id").cast("string").alias("id"))
    return evaluation.verdicts(raw, asked)


@query("SELECT doc_id, doc_id % 3 = 0 AS complete, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 11 AS INT) END AS feasibility FROM documents")
def analysis_contract(c: Corpus) -> DataFrame:
    """Analyses with all fields, without one, and malformed."""
    d = F.col("doc_id")
    kinds = {"string": F.lit("x"), "int": (d % 11).cast("int"), "double": F.lit(1.5), "array<string>": F.array(F.lit("s"))}
    fields = [kinds[f.dataType.simpleString()].alias(f.name) for f in schemas.ANALYSIS]
    raw = F.when(d % 3 == 0, F.to_json(F.struct(*fields))).when(d % 3 == 1, F.to_json(F.struct(*fields[:-1]))).otherwise(F.lit("no json"))
    rows = c.documents.select("doc_id", jsons.analysis_of(raw).alias("a"))
    return rows.select("doc_id", F.col("a").isNotNull().alias("complete"), F.col("a.feasibility_score").alias("feasibility"))


@query("SELECT query_id, paper_id, CAST((row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, paper_id) - 1) // 10 AS INT) AS batch FROM judgments")
def judge_batches(c: Corpus) -> DataFrame:
    return evaluation.batches(c.judgments.select("query_id", "paper_id", "grade"), [F.desc("grade"), F.asc("paper_id")]).select("query_id", "paper_id", "batch")


@query(f"""WITH {_RUNS}, rp AS (SELECT doc_id % 3 AS run, query_id, p, r, f FROM cf), qm AS (SELECT query_id, avg(p) AS p, avg(r) AS r, avg(f) AS f FROM rp GROUP BY 1)
SELECT run, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall, round(avg(f), 6) AS mean_f1 FROM rp GROUP BY 1 UNION ALL SELECT NULL, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM qm""")
def category_report(c: Corpus) -> DataFrame:
    rows = evaluation.category_report(evaluation.category_scores(_runs(c)).withColumn("run", F.col("doc_id") % 3))
    return rows.select("run", *(F.round(x, 6).alias(x) for x in ("mean_precision", "mean_recall", "mean_f1")))


# Table changes and accounts


@query(f"WITH {_QUANT} SELECT paper_id, CASE WHEN paper_id % 3 = 0 OR paper_id % 4 = 1 THEN 'new' ELSE 'old' END AS model_version, CAST(list_sum(q) AS BIGINT) AS total, round(CAST(scale AS DOUBLE), 6) AS scale FROM q8")
def embedding_run(c: Corpus) -> DataFrame:
    """A run with a new model: some papers have no vector, some one of the old model; some stored vectors aren't quantised yet."""
    all_ = c.embeddings
    kept = all_.where("paper_id % 3 <> 0").withColumn("model_version", F.when(F.col("paper_id") % 4 == 1, "new").otherwise("old"))
    whole, bare = dense.quantize(kept.where("paper_id % 2 = 0")).join(kept, "paper_id"), kept.where("paper_id % 2 = 1")
    stored = whole.unionByName(bare, allowMissingColumns=True).select("paper_id", "model_version", "vector", "q", "scale")
    waiting = filters.needs_embedding(all_.where("paper_id % 3 = 0").select("paper_id"), stored, "new")
    rows = dml.with_embeddings(stored, waiting.join(all_, "paper_id"), "new")
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("paper_id", "model_version", total.alias("total"), F.round(F.col("scale").cast("double"), 6).alias("scale"))


@query("SELECT vec_id AS paper_id FROM embeddings WHERE vec_id % 4 <> 1 UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def needs_embedding_of_model(c: Corpus) -> DataFrame:
    have = c.embeddings.withColumn("model_version", F.when(F.col("paper_id") % 4 == 1, "new").otherwise("old"))
    ids = c.papers.select("paper_id").unionByName(c.embeddings.select("paper_id")).distinct()
    return filters.needs_embedding(ids, have, "new").select("paper_id")


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 1 + CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 0 END ELSE 4 END AS version FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def saved_profiles(c: Corpus) -> DataFrame:
    users = c.table("customer").select(F.col("c_custkey").alias("user_id"))
    profiles = users.where("user_id % 2 = 0").withColumn("version", F.lit(4))
    return dml.saved_profile(profiles, users.where("user_id % 3 = 0").withColumn("version", F.lit(0)))


@query("""SELECT s_suppkey AS code, CAST(CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 1 AND s_suppkey % 5 <> 0 THEN s_suppkey % 2 + 1 ELSE s_suppkey % 2 END AS INT) AS used FROM supplier""")
def invite_claims(c: Corpus) -> DataFrame:
    """Codes with uses left or not, expired or not, claimed by active and inactive users."""
    s = F.col("s_suppkey")
    invites = c.table("supplier").select(s.alias("code"), (s % 2).cast("int").alias("used"), F.lit(2).alias("max_uses"), F.when(s % 4 == 1, dates.moment("2020-01-01 00:00:00")).alias("expires_utc"))
    users = c.table("supplier").select(s.alias("user_id"), (s % 5 == 0).alias("is_active"))
    claims = c.table("supplier").where("s_suppkey % 3 = 0").select(s.alias("user_id"), s.alias("code"))
    return workflow.redeemed(invites, users, claims, AS_OF)[0].select("code", "used")


@query("SELECT DISTINCT event_type AS step, CASE WHEN event_type = 'click' THEN 'small' ELSE 'standard' END AS model FROM events")
def step_models(c: Corpus) -> DataFrame:
    frame = c.spark.createDataFrame
    steps = c.table("events").select(F.col("event_type").alias("step")).distinct()
    return accounts.step_models(steps, frame([("click", "small"), ("view", "withdrawn")], "step string, model string"), frame([("small",), ("standard",)], "model string"), "standard")


@query("""WITH o AS (SELECT c_custkey AS user_id, CAST(c_custkey AS VARCHAR) AS external_id FROM customer WHERE c_custkey % 3 = 0), w AS (SELECT CAST(c_custkey AS VARCHAR) AS external_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0),
n AS (SELECT (SELECT max(user_id) FROM o) + row_number() OVER (ORDER BY external_id) AS user_id, external_id FROM w) SELECT user_id, external_id, true AS is_active, CAST(0 AS BIGINT) AS granted FROM o UNION ALL SELECT user_id, external_id, false, CAST(500 AS BIGINT) FROM n""")
def first_logins(c: Corpus) -> DataFrame:
    """Logins of known and unknown people, each twice: who is new gets an account and a first grant."""
    people = c.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").cast("string").alias("external_id"), F.col("c_name").alias("email"))
    logins = people.where("user_id % 2 = 0").select("external_id", "email")
    none = c.spark.createDataFrame([], "user_id long, amount_micros long, reason string, created_utc timestamp_ntz")
    users, grants = dml.with_accounts(people.where("user_id % 3 = 0").withColumn("is_active", F.lit(True)), none, logins.unionByName(logins), 500, AS_OF)
    given = grants.groupBy("user_id").agg(F.sum("amount_micros").alias("granted"))
    return users.join(given, "user_id", "left").select("user_id", "external_id", "is_active", F.coalesce("granted", F.lit(0)).alias("granted"))


@query("SELECT c_custkey AS user_id, 'role' AS action, 'Guest' AS before, 'Member' AS after FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 <> 0")
def role_audit(c: Corpus) -> DataFrame:
    role = F.when(F.col("c_custkey") % 3 == 0, "Member").otherwise("Guest")
    users = c.table("customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"), F.lit(False).alias("is_active"))
    changes = users.where("user_id % 4 = 0").select("user_id", F.lit("Member").alias("role"))
    return dml.with_roles(users, changes.unionByName(changes), AS_OF)[1].select("user_id", "action", "before", "after")


# Runs


@query("""SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(sum(o_orderkey % 7) AS BIGINT) AS fetched, CAST(sum(o_orderkey % 3) AS BIGINT) AS added, CAST(sum(o_orderkey % 2) AS BIGINT) AS updated,
coalesce(substr(string_agg(CASE WHEN o_orderkey % 5 = 0 THEN concat('lost ', CAST(o_orderkey AS VARCHAR)) END, ' | ' ORDER BY CAST(o_orderkey AS VARCHAR)), 1, 2000), '') AS error, CASE WHEN count(*) FILTER (WHERE o_orderkey % 5 = 0) = count(*) THEN 'Failed' ELSE 'Completed' END AS status FROM orders GROUP BY 1""")
def run_audit(c: Corpus) -> DataFrame:
    key = F.col("o_orderkey")
    error = F.when(key % 5 == 0, F.concat(F.lit("lost "), key.cast("string")))
    parts = c.table("orders").select(F.col("o_custkey").cast("string").alias("run_id"), key.cast("string").alias("part"), (key % 7).alias("fetched"), (key % 3).alias("added"), (key % 2).alias("updated"), error.alias("error"))
    return dml.run_summary(parts)


@query("SELECT o_orderkey AS run_id, o_totalprice AS fetched FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def ingestion_runs(c: Corpus) -> DataFrame:
    runs = c.table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_utc"), F.col("o_totalprice").alias("fetched"))
    return workflow.recent_runs(runs, 20).select("run_id", "fetched")


@query(f"SELECT category, CASE WHEN category LIKE 'src%' THEN date_trunc('minute', max(published_utc) + INTERVAL 95 SECOND)::TIMESTAMP ELSE TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY END AS since FROM paper_categories JOIN papers USING (paper_id) GROUP BY 1")
def ingestion_windows(c: Corpus) -> DataFrame:
    marks = dml.high_water_marks(c.papers, c.paper_categories).where("category like 'src%'")
    late = marks.withColumn("high_water_mark_utc", F.col("high_water_mark_utc") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(95)))
    return ingest.fetch_windows(c.paper_categories.select("category").distinct(), late, AS_OF, 7)


@query("SELECT event_type AS type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def event_log_stream(c: Corpus) -> DataFrame:
    """Interactions appended to the log as a stream of files, then counted from the log."""
    base = scratch(c.spark, "log")
    rows = c.table("events").select("event_id", "event_type")
    rows.repartition(3, "event_id").write.parquet(f"{base}/pages")
    ingest.append_stream(c.spark, f"{base}/pages", rows.schema, f"{base}/log", f"{base}/checkpoint", lambda d: d.where("event_type <> 'view'")).awaitTermination()
    return c.spark.read.schema(rows.schema).parquet(f"{base}/log").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


@query("""SELECT primary_category AS category, max(published_utc) AS high_water_mark_utc, (SELECT count(*) FROM papers) AS papers, (SELECT count(DISTINCT paper_id) FROM papers) AS added FROM papers GROUP BY primary_category""")
def ingestion_loop(c: Corpus) -> DataFrame:
    """A run over all languages as categories, from no marks, and a second one from the first's: marks, papers and what was added in all."""
    base, schema = scratch(c.spark, "ingestion"), c.papers.select("paper_id", "title", "published_utc").schema
    categories = c.papers.select(F.col("primary_category").alias("category")).distinct()
    fetch = lambda category, since: c.papers.where((F.col("primary_category") == category) & (F.col("published_utc") >= F.lit(since)))
    for name in ("first", "second"):
        ingest.ingest_run(c.spark, base, categories, fetch, AS_OF, "paper_id", schema, "published_utc", 400, name)
    counted = published(c.spark, f"{base}/papers").agg(F.count("*").alias("papers"))
    added = published(c.spark, f"{base}/runs").agg(F.sum("added").alias("added"))
    return published(c.spark, f"{base}/marks").crossJoin(counted).crossJoin(added)  # of one row each


@query("SELECT doc_id AS id, 1 AS attempts FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 3 = 1")
def work_queue(c: Corpus) -> DataFrame:
    """All documents as work items: a third done at first delivery, a third at the second, which comes when its retry is due; the rest waits."""
    schema = c.documents.select(F.col("doc_id").alias("id"), F.lit(0).alias("attempts")).schema
    queue = WorkQueue(c.spark, scratch(c.spark, "queue"), schema, "id", retry=10.0)
    queue.add(c.documents.select(F.col("doc_id").alias("id"), F.lit(0).alias("attempts")))
    for now, kinds in ((0.0, "id % 3 = 0"), (5.0, "id % 3 = 1"), (11.0, "id % 3 = 1")):
        queue.deliver(lambda d, k=kinds: d.where(k).select("id", (F.col("attempts") + 1).alias("attempts")), now)
    return queue.results()


@query("SELECT lang AS token_of, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def harvested_pages(c: Corpus) -> DataFrame:
    """Every document as a page of one recorded harvest, each naming the next, streamed page by page and counted from what arrived."""
    base = scratch(c.spark, "harvest")
    ranked = ranking.ranks(c.documents.select("doc_id", "lang", "n_chars"), [], ["doc_id"])
    token = lambda n: F.concat(F.lit("t"), n.cast("string"))
    own, following = F.when(F.col("rank") == 1, "").otherwise(token(F.col("rank"))), F.when(F.col("rank") < F.col("size"), token(F.col("rank") + 1))
    pages = ranked.select(F.to_json(F.struct(own.alias("token"), F.coalesce(following, F.lit("")).alias("next"), F.to_json(F.struct("lang", "n_chars")).alias("body"))).alias("value"))
    pages.write.text(f"{base}/pages")
    c.spark.dataSource.register(connectors.HarvestStream)
    rows = c.spark.readStream.format("harvest_pages").option("path", f"{base}/pages").load()
    rows.writeStream.format("parquet").option("path", f"{base}/sink").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    parsed = c.spark.read.schema("token string, body string").parquet(f"{base}/sink").select(F.from_json("body", "lang string, n_chars long").alias("b"))
    return parsed.groupBy(F.col("b.lang").alias("token_of")).agg(F.count("*").alias("pages"), F.sum("b.n_chars").alias("chars"))


@query("SELECT lang AS category, count(*) AS entries, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY lang")
def paged_entries(c: Corpus) -> DataFrame:
    """Every document as an entry of a paged service, a category for each language, its pages read by tasks of their own."""
    base = scratch(c.spark, "service")
    ranked = ranking.ranks(c.documents.select("lang", "doc_id"), ["lang"], ["doc_id"])
    replies = ranked.groupBy("lang", F.floor((F.col("rank") - 1) / 50).alias("page")).agg(F.max("size").alias("total"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
    replies.withColumn("category", F.col("lang")).write.partitionBy("lang", "page").json(f"{base}/replies")
    c.spark.dataSource.register(connectors.PagedService)
    categories = sorted(r.lang for r in c.documents.select("lang").distinct().collect())
    rows = c.spark.read.format("paged_service").options(fetch="lectern.sources.connectors:stored_reply", at=f"{base}/replies", categories=",".join(categories), size=50, lanes=4).load()
    return rows.groupBy("category").agg(F.count("*").alias("entries"), F.sum(F.col("entry").cast("long")).alias("ids"))


@query("SELECT doc_id AS paper_id, q.item_id AS query_id, length(d.text) + length(q.text) AS score FROM documents d JOIN benchmark q ON q.item_id = d.doc_id % 40")
def pairs_by_length(c: Corpus) -> DataFrame:
    """Every document with a benchmark item, scored in batches of pairs of about one length by a stand-in for a cross-encoder."""
    items = c.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = c.documents.select(F.col("doc_id").alias("paper_id"), F.col("text").alias("passage"), (F.col("doc_id") % 40).alias("query_id")).join(items, "query_id")
    scored = connectors.scored_by_length(pairs.select("query_id", "paper_id", "query", "passage"), lambda batch: [float(len(q) + len(p)) for q, p in batch], 32)
    return scored.select("paper_id", "query_id", F.col("score").cast("long").alias("score"))


@query(f"WITH {_TERMS} SELECT term, paper_id, tf, CAST(len(ws) AS INT) AS dl, df FROM tf JOIN docs USING (paper_id) JOIN df USING (term)")
def stored_postings(c: Corpus) -> DataFrame:
    return c.lexicon.postings.join(c.lexicon.terms, "term").select("term", "paper_id", "tf", "dl", "df")


@query("SELECT count(*) AS n FROM documents")
def postings_of_parsed_text(c: Corpus) -> DataFrame:
    """Every paper has a length, whether or not it has a term."""
    return lexical.lengths(c.papers).agg(F.count("*").alias("n"))


def _counted(names: list[str]) -> list[dict | None]:
    """A stand-in for a service of signals: it doesn't know papers whose id ends in 9."""
    return [None if n[-1] == "9" else {"citation_count": int(n[-5:]) % 97, "influential_citation_count": 0, "github_stars": None} for n in names]


@query("""WITH old AS (SELECT paper_id, citation_count, TIMESTAMP '2024-12-31 00:00:00' - INTERVAL 1 DAY * (citation_count % 40) < TIMESTAMP '2024-12-17 00:00:00' AS late FROM signals),
al AS (SELECT p.paper_id, o.paper_id IS NOT NULL AS had, o.citation_count AS before, (o.paper_id IS NULL OR late) AND right(arxiv_id, 1) <> '9' AS fresh, CAST(right(arxiv_id, 5) AS INT) % 97 AS counted FROM papers p LEFT JOIN old o ON o.paper_id = p.paper_id)
SELECT paper_id, CASE WHEN fresh THEN counted ELSE before END AS citation_count, fresh FROM al WHERE had OR fresh""")
def enriched_signals(c: Corpus) -> DataFrame:
    """The table of signals after a run asked for all that are missing or two weeks old."""
    path, at = scratch(c.spark, "signals"), dates.moment(AS_OF)
    held = [F.lit(None).cast("int").alias(n) for n in ("influential_citation_count", "github_stars")]
    publish(c.spark, path, c.signals.select("paper_id", "citation_count", *held, (at - F.make_dt_interval(F.col("citation_count") % 40)).alias("fetched_utc")))
    rows = runs.enrich(c.papers, path, AS_OF, _counted)[0]
    return rows.select("paper_id", "citation_count", F.col("influential_citation_count").isNotNull().alias("fresh"))


def _analysed(passages: list[str]) -> list[str]:
    """A stand-in for a model of analyses: by a passage's first character it answers well, or not by the contract."""
    kinds = {"string": "x", "int": 3, "array<string>": ["s"]}
    whole = lambda n: {f.name: kinds.get(f.dataType.simpleString(), n % 10) for f in schemas.ANALYSIS}
    return [json.dumps(whole(ord(p[0]))) if p and ord(p[0]) % 3 else "no json" for p in passages]


@query("""WITH al AS (SELECT p.paper_id, unicode(title) AS u, a.profile_version AS v, a.composite_score AS s,
  p.paper_id IN (SELECT paper_id FROM paper_categories WHERE category = 'en') AND coalesce(a.profile_version, 1) <> 2 AND unicode(title) % 3 <> 0 AS fresh FROM papers p LEFT JOIN analyses a ON a.paper_id = p.paper_id)
SELECT paper_id, CASE WHEN fresh THEN 2 ELSE v END AS profile_version, CASE WHEN fresh THEN CAST(u % 10 AS DOUBLE) ELSE s END AS composite_score, fresh FROM al WHERE fresh OR v IS NOT NULL""")
def analyses_of_category(c: Corpus) -> DataFrame:
    """The analyses of all papers after a run over a category: its papers without one of profile version 2 were analysed."""
    path = scratch(c.spark, "analyses")
    own = {f.name for f in c.analyses.schema}
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ANALYSIS_RESULT if f.name not in own]
    old = c.analyses.withColumn("composite_score", F.col("composite_score").cast("decimal(5,2)")).select("*", *lacking).withColumn("created_utc", dates.moment("2024-01-01 00:00:00"))
    publish(c.spark, path, old.select(*schemas.ANALYSIS_RESULT.names))
    rows = runs.analyze(c.papers, c.paper_categories, path, "en", AS_OF, "stand-in", _analysed, 1, 2)[0]
    return rows.select("paper_id", "profile_version", F.col("composite_score").cast("double").alias("composite_score"), F.col("model").isNotNull().alias("fresh"))
