"""Registered queries: text functions, evaluation, telemetry, accounts, table changes, sources, streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import jsons, text
from lectern.operators import dml, lexical, ranking
from lectern.plans import accounts, browse, evaluation, telemetry, workflow
from lectern.queries import _BM25, _queries, query
from lectern.sources import connectors, xml_feeds
from lectern.streaming import ingest
from lectern.tables import scratch
from lectern.views import AS_OF, Corpus

# Text functions

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query("""WITH p AS (SELECT item_id, text, list_filter(list_transform(string_split_regex(text, '[,;\n]'), lambda x: trim(x, ' ')), lambda x: length(x) >= 3)[1:20] AS t FROM benchmark)
SELECT item_id, CASE WHEN len(t) >= 2 THEN len(t) ELSE 1 END::INT AS topics, array_to_string(CASE WHEN len(t) >= 2 THEN t ELSE [text] END, '|') AS anchors FROM p""")
def split_anchors(c: Corpus) -> DataFrame:
    rows = c.table("benchmark").select("item_id", text.split_anchors(F.col("text")).alias("t"))
    return rows.select("item_id", F.size("t").alias("topics"), F.array_join("t", "|").alias("anchors"))


@query(f"SELECT doc_id, concat('adopted-', array_to_string({_WORDS}[1:6], '-')) AS slug FROM documents")
def slug(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("SELECT conv_id, turn, lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'), ' ')) AS normal FROM logged_queries")
def normalize(c: Corpus) -> DataFrame:
    return c.logged_queries.select("conv_id", "turn", text.normalized_query(F.col("query_text")).alias("normal"))


@query("SELECT paper_id, arxiv_id AS id, CAST(CASE WHEN paper_id % 3 = 0 THEN 1 ELSE paper_id % 7 + 1 END AS INT) AS version FROM papers")
def versioned_id(c: Corpus) -> DataFrame:
    raw = F.when(F.col("paper_id") % 3 == 0, F.col("arxiv_id")).otherwise(F.concat("arxiv_id", F.lit("v"), (F.col("paper_id") % 7 + 1).cast("string")))
    return c.papers.select("paper_id", text.versioned_id(raw).alias("v")).select("paper_id", "v.id", "v.version")


@query("SELECT paper_id, code_url AS found FROM papers")
def code_url(c: Corpus) -> DataFrame:
    body = F.concat(F.lit("Code: "), F.coalesce("code_url", F.lit("none")), F.when(F.col("paper_id") % 8 == 0, ".: see").otherwise(", see"))
    return c.papers.select("paper_id", text.code_url(body).alias("found"))


@query("SELECT paper_id, regexp_extract(code_url, 'github\\.com/([^/]+/[^/]+)\\.git$', 1) AS repo FROM papers WHERE code_url IS NOT NULL")
def github_repo(c: Corpus) -> DataFrame:
    return c.papers.where("code_url is not null").select("paper_id", text.github_repo(F.col("code_url")).alias("repo"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE concat(c_mktsegment, ' ', c_name) END AS author FROM customer")
def author_format(c: Corpus) -> DataFrame:
    forenames = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return c.table("customer").select("c_custkey", text.author_name(forenames, F.col("c_name")).alias("author"))


@query("SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN 'physics:astro-ph' ELSE source END AS harvest FROM documents")
def oai_set(c: Corpus) -> DataFrame:
    code = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(".LG"))).when(F.col("doc_id") % 3 == 1, F.lit("astro-ph.CO")).otherwise(F.concat("source", F.lit(".x")))
    return c.documents.select(text.harvest_set(code).alias("harvest")).distinct()


@query("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 40), '…') ELSE text END AS preview FROM conversations")
def truncate_preview(c: Corpus) -> DataFrame:
    return c.table("conversations").select("conv_id", "turn", text.truncated(F.col("text"), 40, "…").alias("preview"))


@query("SELECT doc_id, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(source, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS BIGINT) AS seed FROM documents")
def fnv1a_seed(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", text.fnv1a_32(F.col("source")).alias("seed"))


@query("""WITH w AS (SELECT paper_id, unnest(string_split_regex(lower(concat(title, '. ', abstract)), '[ ,.;:\n]')) AS w FROM papers),
h AS (SELECT paper_id, list_reduce(list_prepend(CAST(23 AS BIGINT), list_transform(string_split(w, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda h, x: (h * 31 + x) & 4294967295) AS h FROM w WHERE length(w) > 2),
n AS (SELECT paper_id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 64 AS slot, count(*) AS n FROM h GROUP BY 1, 2),
t AS (SELECT paper_id, sqrt(sum(n * n)) AS norm, CAST(sum(n * (slot + 1)) AS DOUBLE) AS moment, max(n) AS top FROM n GROUP BY 1)
SELECT p.paper_id, round(coalesce(moment / norm, 0), 6) AS moment, round(coalesce(top / norm, 0), 6) AS largest FROM papers p LEFT JOIN t USING (paper_id)""")
def hash_embedding(c: Corpus) -> DataFrame:
    """Stand-in vectors of all titles and abstracts, by their first moment and largest component."""
    papers = c.papers.select("paper_id", text.document_text(F.col("title"), F.col("abstract")).alias("text"))
    rows = papers.select("paper_id", connectors.stand_in_embedding(F.col("text")).alias("v"))
    moment = F.aggregate(F.zip_with("v", F.sequence(F.lit(1), F.size("v")), lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x)
    return rows.select("paper_id", F.round(moment, 6).alias("moment"), F.round(F.array_max("v"), 6).alias("largest"))


# JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_plan_extract(c: Corpus) -> DataFrame:
    plan = F.concat(F.lit('{"anchorText":"a","dateWindowDays":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return c.table("events").select("event_id", jsons.plan_of(plan).alias("p")).select("event_id", F.col("p.dateWindowDays").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS interpretation FROM events")
def interpretation_tolerant(c: Corpus) -> DataFrame:
    good = F.concat(F.lit('{"interpretation":"'), F.col("event_type"), F.lit('"}'))
    raw = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.lit("{broken")).otherwise(F.lit("{}"))
    return c.table("events").select("event_id", jsons.field_or_blank(raw, "$.interpretation").alias("interpretation"))


# Evaluation: BM25 rankings of benchmark items as queries, grades from labels

_RANKED = _BM25.replace("{0}", "").replace("SELECT query_id, paper_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM rk WHERE rank <= 30", "")
_GRADES = """ga AS (SELECT b.item_id AS query_id, l.doc_id AS paper_id, CAST(quality * 2 + toxic AS INT) AS grade, CASE WHEN l.doc_id % 3 = 0 THEN 'random' ELSE 'pool' END AS source FROM labels l JOIN benchmark b ON b.item_id = l.doc_id % 40),
gj AS (SELECT * FROM (SELECT * FROM ga UNION ALL SELECT query_id, paper_id, 3 - grade, 'again' FROM ga WHERE paper_id % 5 = 0) QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY source, grade) = 1)"""
_METRICS = _RANKED.rstrip() + f""",
{_GRADES},
gr AS (SELECT rk.query_id, rk.paper_id, rk.rank, coalesce(gj.grade, 0) AS grade, gj.grade IS NOT NULL AS judged FROM rk LEFT JOIN gj USING (query_id, paper_id) WHERE rank <= 50),
sh AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg, count(*) FILTER (WHERE grade >= 2) AS found, min(rank) FILTER (WHERE grade >= 2) AS first, count(*) FILTER (WHERE rank <= 10 AND judged) AS judged_at_k FROM gr GROUP BY 1),
be AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (WHERE grade > 0 AND r <= 10) AS ideal, count(*) AS judged, count(*) FILTER (WHERE grade >= 2) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM gj) GROUP BY 1),
mt AS (SELECT be.query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal END AS ndcg, CASE WHEN relevant > 0 THEN coalesce(found, 0) / relevant END AS recall, CASE WHEN relevant > 0 THEN coalesce(1.0 / first, 0) END AS reciprocal_rank, coalesce(judged_at_k, 0) AS judged_at_k, judged, relevant FROM be LEFT JOIN sh USING (query_id))"""


def _item_judgments(c: Corpus) -> DataFrame:
    """The fixture's grades, dealt over benchmark items by id; a fifth is judged a second time."""
    grade, source = (F.col("quality") * 2 + F.col("toxic")).cast("int"), F.when(F.col("doc_id") % 3 == 0, "random").otherwise("pool")
    graded = c.table("labels").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("paper_id"), grade.alias("grade"), source.alias("source"))
    again = graded.where("paper_id % 5 = 0").select("query_id", "paper_id", (3 - F.col("grade")).alias("grade"), F.lit("again").alias("source"))
    return graded.unionByName(again).join(c.table("benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")


def _metrics(c: Corpus) -> DataFrame:
    return evaluation.metrics(lexical.bm25(c.papers, _queries(c), 50), _item_judgments(c))


@query("WITH " + _METRICS + " SELECT query_id, round(ndcg, 6) AS ndcg FROM mt")
def ndcg_at_10(c: Corpus) -> DataFrame:
    return _metrics(c).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("WITH " + _METRICS + " SELECT query_id, round(recall, 6) AS recall FROM mt")
def recall_at_50(c: Corpus) -> DataFrame:
    return _metrics(c).select("query_id", F.round("recall", 6).alias("recall"))


@query("WITH " + _METRICS + " SELECT query_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM mt")
def mrr(c: Corpus) -> DataFrame:
    return _metrics(c).select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query("WITH " + _METRICS + " SELECT round(avg(ndcg), 6) AS mean_ndcg, round(avg(recall), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank, count(*) AS queries, CAST(sum(judged_at_k) AS BIGINT) AS judged_at_k, CAST(sum(relevant) AS BIGINT) AS relevant FROM mt")
def eval_report(c: Corpus) -> DataFrame:
    per = _metrics(c)
    counts = per.agg(F.sum("judged_at_k").alias("judged_at_k"), F.sum("relevant").alias("relevant"))
    rows = evaluation.means(per).join(F.broadcast(counts))
    return rows.select(*(F.round(x, 6).alias(x) for x in ("mean_ndcg", "mean_recall", "mean_reciprocal_rank")), "queries", "judged_at_k", "relevant")


@query("SELECT orig, count(*) FILTER (WHERE cal = 0) AS cal_0, count(*) FILTER (WHERE cal = 1) AS cal_1, count(*) FILTER (WHERE cal = 2) AS cal_2, count(*) FILTER (WHERE cal = 3) AS cal_3 FROM calibration GROUP BY orig")
def confusion_pivot(c: Corpus) -> DataFrame:
    return evaluation.confusion_pivot(c.calibration)


@query("""WITH g AS (SELECT o.i AS orig, k.i AS cal FROM range(4) o(i), range(4) k(i)), n AS (SELECT g.orig, g.cal, count(c.paper_id) AS n FROM g LEFT JOIN calibration c ON c.orig = g.orig AND c.cal = g.cal GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY orig) AS r, sum(n) OVER (PARTITION BY cal) AS k, pow(orig - cal, 2) / 9.0 AS w FROM n)
SELECT CAST(sum(n) AS BIGINT) AS n, round(1 - sum(w * n) * sum(n) / sum(w * r * k), 9) AS kappa FROM m""")
def qwk(c: Corpus) -> DataFrame:
    return evaluation.weighted_kappa(c.calibration).select("n", F.round("kappa", 9).alias("kappa"))


@query("SELECT count(*) AS n, round(avg(CAST(orig = cal AS DOUBLE)), 9) AS exact, round(avg(CAST(abs(orig - cal) <= 1 AS DOUBLE)), 9) AS within_one, string_agg(DISTINCT concat('judge ', paper_id % 3), ', ' ORDER BY concat('judge ', paper_id % 3)) AS judges FROM calibration")
def agreement(c: Corpus) -> DataFrame:
    pairs = c.calibration.withColumn("judge", F.concat(F.lit("judge "), (F.col("paper_id") % 3).cast("string")))
    return evaluation.agreement(pairs).select("n", F.round("exact", 9).alias("exact"), F.round("within_one", 9).alias("within_one"), "judges")


@query("SELECT paper_id, orig, cal, CAST(abs(orig - cal) AS INT) AS apart FROM calibration WHERE abs(orig - cal) >= 2 ORDER BY apart DESC, paper_id LIMIT 8")
def worst_disagreements(c: Corpus) -> DataFrame:
    return evaluation.disagreements(c.calibration).select("paper_id", "orig", "cal", F.col("apart").cast("int").alias("apart"))


_RUNS = """rn AS (SELECT doc_id, lang AS query_id, CASE WHEN doc_id % 7 = 0 THEN [] ELSE [lang, source] END AS em, CASE WHEN doc_id % 5 = 0 THEN [lang] ELSE [lang, 'src1', 'src2'] END AS ex, ['src3'] AS ok FROM documents),
sc AS (SELECT doc_id, query_id, em, CASE WHEN len(em) = 0 THEN 1.0 ELSE len(list_intersect(em, list_distinct(list_concat(ex, ok)))) / len(em) END AS p, len(list_intersect(em, ex)) / len(ex) AS r FROM rn),
cf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM sc)"""


def _runs(c: Corpus) -> DataFrame:
    upper, none = F.upper("lang"), F.array().cast("array<string>")
    emitted = F.when(F.col("doc_id") % 7 == 0, none).otherwise(F.array(upper, "source"))
    expected = F.when(F.col("doc_id") % 5 == 0, F.array("lang")).otherwise(F.array(F.col("lang"), F.lit("src1"), F.lit("SRC2")))
    return c.documents.select("doc_id", F.col("lang").alias("query_id"), emitted.alias("emitted"), expected.alias("expected"), F.array(F.lit("src3")).alias("acceptable"))


@query(f"WITH {_RUNS} SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(r, 6) AS reachable_recall, round(f, 6) AS f1 FROM cf")
def category_prf(c: Corpus) -> DataFrame:
    rows = evaluation.category_scores(_runs(c))
    return rows.select("doc_id", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "reachable_recall", "f1")))


@query(f"WITH {_RUNS} SELECT query_id, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall, round(avg(f), 6) AS mean_f1, round(min(f), 6) AS min_f1, round(max(f), 6) AS max_f1, count(*) AS runs FROM cf GROUP BY 1")
def category_multi_run(c: Corpus) -> DataFrame:
    rows = evaluation.category_means(evaluation.category_scores(_runs(c)))
    return rows.select("query_id", *(F.round(x, 6).alias(x) for x in ("mean_precision", "mean_recall", "mean_f1", "min_f1", "max_f1")), "runs")


@query(f"WITH {_RUNS}, x AS (SELECT query_id, unnest(em) AS category FROM rn), n AS (SELECT query_id, CASE WHEN category = query_id THEN upper(category) ELSE category END AS category, count(*) AS n FROM x GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, category) AS INT) AS place FROM n")
def category_occurrences(c: Corpus) -> DataFrame:
    return evaluation.category_occurrences(_runs(c))


@query("""WITH k AS (SELECT lang AS query_id, count(*) AS candidates FROM documents GROUP BY 1), j AS (SELECT query_id, count(*) FILTER (WHERE source = 'random') AS sampled, count(*) FILTER (WHERE source = 'random' AND grade >= 2) AS relevant, count(*) FILTER (WHERE source = 'pool' AND grade >= 2) AS surfaced FROM judgments GROUP BY 1)
SELECT query_id, sampled, relevant, candidates, surfaced, round(relevant / nullif(sampled, 0) * greatest(0, candidates - 50), 6) AS estimate FROM k JOIN j USING (query_id)""")
def missed_gems_audit(c: Corpus) -> DataFrame:
    candidates = c.documents.groupBy(F.col("lang").alias("query_id")).agg(F.count("*").alias("candidates"))
    return evaluation.missed_gems(c.judgments, candidates).withColumn("estimate", F.round("estimate", 6))


_KEY = "md5(concat(query_id, ':', CAST(paper_id AS VARCHAR)))"


@query(f"SELECT query_id, paper_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY {_KEY}, paper_id) AS n FROM judgments) WHERE n <= 13")
def stratified_sample(c: Corpus) -> DataFrame:
    return evaluation.stratified(c.judgments, 50).select("query_id", "paper_id", "grade")


@query(f"SELECT query_id, paper_id FROM (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY {_KEY}, paper_id) AS n FROM (SELECT lang AS query_id, doc_id AS paper_id FROM documents WHERE doc_id NOT IN (SELECT paper_id FROM judgments WHERE source = 'pool'))) WHERE n <= 20")
def random_judge_pool(c: Corpus) -> DataFrame:
    candidates = c.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("paper_id"))
    return evaluation.random_sample(candidates, c.judgments.where("source = 'pool'"), 20).select("query_id", "paper_id")


@query("SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL) AS present, count(*) FILTER (WHERE d.doc_id IS NULL) AS missing FROM (SELECT DISTINCT doc_id * 2 AS id FROM labels) l LEFT JOIN documents d ON d.doc_id = l.id")
def judged_availability(c: Corpus) -> DataFrame:
    return evaluation.availability(c.table("labels").select((F.col("doc_id") * 2).alias("paper_id")), c.papers)


_GRID = "(SELECT CAST(row_number() OVER (ORDER BY a, b, k) - 1 AS INT) AS config_id, a, b, k FROM (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS a), (SELECT unnest([0.0, 0.05, 0.1]) AS b), (SELECT unnest([0.0, 0.1, 0.2]) AS k))"


@query(f"""WITH g AS {_GRID}, b AS (SELECT p.paper_id, p.primary_category AS query_id, (p.paper_id % 100) / 100.0 AS score, pow(2, -greatest(0, date_diff('microsecond', published_utc, TIMESTAMP '{AS_OF}') / 86400000000.0) / 365.0) AS fresh, CASE WHEN code_url IS NOT NULL THEN 1.0 ELSE 0.0 END AS code, least(1, ln(1 + coalesce(citation_count, 0)) / ln(1001)) AS cited FROM papers p LEFT JOIN signals USING (paper_id)),
r AS (SELECT config_id, query_id, paper_id, row_number() OVER (PARTITION BY config_id, query_id ORDER BY round(score + a * fresh + b * code + k * cited, 9) DESC, round(score, 9) DESC, paper_id) AS rank FROM b, g),
j AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM judgments), i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(n + 1)) AS ideal FROM j WHERE n <= 10 AND grade > 0 GROUP BY 1),
d AS (SELECT r.config_id, r.query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM r JOIN judgments j USING (query_id, paper_id) WHERE rank <= 10 GROUP BY 1, 2),
m AS (SELECT g.config_id, avg(coalesce(dcg, 0) / ideal) AS v FROM g, i LEFT JOIN d ON d.config_id = g.config_id AND d.query_id = i.query_id GROUP BY 1)
SELECT config_id, round(v, 6) AS mean_ndcg, CAST(row_number() OVER (ORDER BY round(v, 9) DESC, config_id) AS INT) AS place FROM m""")
def weight_grid_tune(c: Corpus) -> DataFrame:
    """Every combination of weights in one job: rankings by configuration and query, scored together."""
    grid = telemetry.weight_grid(c.spark, (0.0, 0.05, 0.1, 0.2), (0.0, 0.05, 0.1), (0.0, 0.1, 0.2))
    scored = c.papers.select("paper_id", F.col("primary_category").alias("lang"), ((F.col("paper_id") % 100) / 100.0).alias("score"))
    known = ranking.blend_signals(scored, c.papers, c.signals, AS_OF)
    tried = known.crossJoin(F.broadcast(grid))  # 36 rows, whatever the corpus
    blended = tried.withColumn("blended", ranking.blended(1.0, F.col("w_recency"), F.col("w_code"), F.col("w_citations")))
    keyed = blended.withColumn("query_id", F.concat_ws("|", F.col("config_id").cast("string"), "lang"))
    best = keyed.withColumn("part", F.pmod(F.xxhash64("paper_id"), F.lit(64)))  # each part keeps its ten first: no group is gathered whole
    order = [F.desc(F.round("blended", 9)), F.desc(F.round("score", 9)), F.asc("paper_id")]
    first = best.withColumn("n", F.row_number().over(W.partitionBy("query_id", "part").orderBy(*order))).where("n <= 10")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where("rank <= 10")
    judged = c.judgments.join(F.broadcast(grid.select("config_id"))).withColumn("query_id", F.concat_ws("|", F.col("config_id").cast("string"), "query_id"))
    per = evaluation.metrics(ranked.select("query_id", "paper_id", "rank"), judged)
    means = per.groupBy(F.substring_index("query_id", "|", 1).cast("int").alias("config_id")).agg(F.avg("ndcg").alias("v"))
    place = F.row_number().over(W.orderBy(F.desc(F.round("v", 9)), "config_id"))
    return means.select("config_id", F.round("v", 6).alias("mean_ndcg"), place.alias("place"))


# Telemetry

_HEAD = "hd AS (SELECT s.*, p.primary_category, p.published_utc, p.abstract FROM slots s JOIN papers p USING (paper_id) WHERE rank <= 10)"
_PLANS = "pc AS (SELECT p.paper_id, p.primary_category, p.published_utc, p.abstract, k AS plan_id FROM papers p, (SELECT unnest([0, 1, 2]) AS k) WHERE (k = 0 OR (k = 1 AND p.paper_id % 2 = 0) OR (k = 2 AND code_url IS NULL))), ev AS (SELECT search_event_id, user_id % 4 AS plan_id FROM searches)"


def _plan_candidates(c: Corpus) -> DataFrame:
    """Three plans over the corpus; the fourth has no candidates."""
    which = F.array_compact(F.array(F.lit(0), F.when(F.col("paper_id") % 2 == 0, 1), F.when(F.col("code_url").isNull(), 2)))
    return c.papers.select("paper_id", "published_utc", "abstract", F.col("primary_category").alias("category"), F.explode(which).alias("plan_id"))


def _events(c: Corpus) -> DataFrame:
    return c.searches.select((F.col("user_id") % 4).cast("int").alias("plan_id"))


@query(f"""WITH {_HEAD}, {_PLANS}, sh AS (SELECT primary_category AS category, count(*) / sum(count(*)) OVER () AS shown FROM hd GROUP BY 1),
ps AS (SELECT plan_id, primary_category AS category, count(*) / sum(count(*)) OVER (PARTITION BY plan_id) AS share FROM pc GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM ev WHERE plan_id < 3),
po AS (SELECT category, sum(share) / (SELECT n FROM n) AS pool FROM ev JOIN ps USING (plan_id) GROUP BY 1)
SELECT category, round(coalesce(shown, 0), 6) AS shown, round(coalesce(pool, 0), 6) AS pool, round(coalesce(shown, 0) - coalesce(pool, 0), 6) AS delta FROM sh FULL JOIN po USING (category) ORDER BY round(abs(coalesce(shown, 0) - coalesce(pool, 0)), 9) DESC, category LIMIT 8""")
def bias_category_delta(c: Corpus) -> DataFrame:
    shown = telemetry.shown_share(telemetry.head_papers(c.slots, c.papers))
    rows = telemetry.category_deltas(shown, telemetry.pool_share(_events(c), _plan_candidates(c)))
    return rows.select("category", *(F.round(x, 6).alias(x) for x in ("shown", "pool", "delta")))


_DAYS = f"date_diff('microsecond', published_utc, TIMESTAMP '{AS_OF}') / 86400000000.0"


@query(f"""WITH {_HEAD}, {_PLANS}, st AS (SELECT plan_id, avg({_DAYS}) AS age, avg(length(abstract)) AS len FROM pc GROUP BY 1)
SELECT (SELECT round(avg({_DAYS}), 6) FROM hd) AS shown_age, (SELECT round(avg(length(abstract)), 6) FROM hd) AS shown_length, round(avg(age), 6) AS pool_age, round(avg(len), 6) AS pool_length FROM ev JOIN st USING (plan_id)""")
def bias_recency_length(c: Corpus) -> DataFrame:
    rows = telemetry.skew(telemetry.head_papers(c.slots, c.papers), _events(c), _plan_candidates(c), AS_OF)
    return rows.select(*(F.round(x, 6).alias(x) for x in rows.columns))


@query("SELECT n, close * 100 // n AS close_percent, stretch * 100 // n AS stretch_percent, (n - close - stretch) * 100 // n AS neutral_percent FROM (SELECT count(*) AS n, count(*) FILTER (WHERE proximity = 'close') AS close, count(*) FILTER (WHERE proximity = 'stretch') AS stretch FROM slots WHERE rank <= 10 AND NOT is_wildcard)")
def comfort_zone(c: Corpus) -> DataFrame:
    return telemetry.comfort_zone(telemetry.head_papers(c.slots, c.papers))


@query("""WITH a AS (SELECT i.*, w.k IS NOT NULL AS hit FROM interactions i LEFT JOIN (SELECT DISTINCT search_event_id, paper_id, 1 AS k FROM slots WHERE is_wildcard) w USING (search_event_id, paper_id) WHERE search_event_id IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE is_wildcard) AS wild, count(*) FILTER (WHERE NOT is_wildcard) AS plain FROM slots), h AS (SELECT count(*) FILTER (WHERE hit) AS wild_hits, count(*) FILTER (WHERE NOT hit) AS plain_hits FROM a)
SELECT wild, wild_hits, plain, plain_hits, round(wild_hits / wild, 9) AS wild_yield, round(plain_hits / plain, 9) AS plain_yield FROM s, h""")
def wildcard_yield(c: Corpus) -> DataFrame:
    rows = telemetry.wildcard_yield(c.slots, c.interactions)
    return rows.withColumn("wild_yield", F.round("wild_yield", 9)).withColumn("plain_yield", F.round("plain_yield", 9))


@query("""SELECT *, n >= 10 AND top3 >= n * 9 // 10 AS warns FROM (SELECT count(search_event_id) AS n, count(*) FILTER (WHERE rank BETWEEN 1 AND 3) AS top3, count(*) FILTER (WHERE rank BETWEEN 4 AND 10) AS mid, count(*) FILTER (WHERE rank > 10) AS tail,
count(*) FILTER (WHERE search_event_id IS NOT NULL AND rank IS NULL) AS unresolved, count(*) FILTER (WHERE search_event_id IS NULL) AS without_search FROM interactions)""")
def position_histogram(c: Corpus) -> DataFrame:
    return telemetry.positions(c.interactions)


@query("""WITH v AS (SELECT variant, count(*) AS votes FROM interactions JOIN slots USING (search_event_id, paper_id) GROUP BY 1) SELECT s.variant, s.slots, coalesce(v.votes, 0) AS votes FROM (SELECT variant, count(*) AS slots FROM slots GROUP BY 1) s LEFT JOIN v USING (variant)""")
def interleave_votes(c: Corpus) -> DataFrame:
    return telemetry.interleaving_votes(c.slots, c.interactions)


_LOG = "lg AS (SELECT conv_id, turn, query_text, lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'), ' ')) AS key, conv_id * 1000 + turn AS created FROM logged_queries)"


def _logged(c: Corpus) -> DataFrame:
    created = F.col("conv_id") * 1000 + F.col("turn")
    return c.logged_queries.select("query_text", created.alias("created"), created.alias("search_id"), F.concat(F.lit("plan-"), created.cast("string")).alias("plan"))


@query(f"""WITH {_LOG}, b AS (SELECT key, arg_max(query_text, created) AS query_text, concat('plan-', CAST(max(created) AS VARCHAR)) AS plan, count(*) AS uses FROM lg WHERE key <> '' GROUP BY 1),
s AS (SELECT *, concat('adopted-', array_to_string(regexp_extract_all(key, '[a-z0-9]+')[1:6], '-')) AS slug FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY key) AS n FROM s)
SELECT CASE WHEN n = 1 THEN slug ELSE concat(slug, '-', CAST(n AS VARCHAR)) END AS query_id, query_text, plan, uses FROM n""")
def adopt_newest(c: Corpus) -> DataFrame:
    return telemetry.adopt(_logged(c))


@query(f"WITH {_LOG} SELECT created AS search_id, query_text FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created DESC) AS n FROM lg WHERE key <> '') WHERE n = 1 ORDER BY created DESC LIMIT 50")
def recent_searches(c: Corpus) -> DataFrame:
    return browse.recent_searches(_logged(c), 50).select("search_id", "query_text")


@query("SELECT s.rank, s.paper_id, p.title FROM slots s JOIN papers p USING (paper_id) WHERE search_event_id = (SELECT min(search_event_id) FROM searches)")
def replay(c: Corpus) -> DataFrame:
    first = c.searches.orderBy("search_event_id").first()
    return browse.replay(c.slots, c.searches, first.search_event_id, first.user_id, c.papers).select("rank", "paper_id", "title")


@query("SELECT i.interaction_id, CAST(s.rank AS INT) AS rank FROM interactions i LEFT JOIN slots s USING (search_event_id, paper_id)")
def rank_resolution(c: Corpus) -> DataFrame:
    unranked = c.interactions.withColumn("rank", F.lit(None).cast("int"))
    return telemetry.resolved_ranks(unranked, c.slots).select("interaction_id", "rank")


@query("SELECT search_event_id, rank, paper_id FROM slots WHERE paper_id % 5 <> 0")
def surrogate_key_slots(c: Corpus) -> DataFrame:
    """Hits on papers that the corpus lacks go, and keep their rank. The view's arxiv_id is cut to five digits, so from 100,000 papers
    on several share one; here it is whole."""
    whole = F.format_string("2401.%05d", "paper_id").alias("arxiv_id")
    hits = c.slots.select("search_event_id", F.col("rank").alias("position"), whole)
    return telemetry.logged_slots(hits, c.papers.where("paper_id % 5 <> 0").select("paper_id", whole))


# Accounts


@query("""SELECT u.user_id, coalesce(g.granted, 0)::BIGINT AS granted, coalesce(s.spent, 0)::BIGINT AS spent, greatest(0, coalesce(g.granted, 0) - coalesce(s.spent, 0))::BIGINT AS remaining FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, sum(amount_micros) AS granted FROM grants GROUP BY 1) g USING (user_id) LEFT JOIN (SELECT user_id, sum(cost_micros) AS spent FROM usage WHERE NOT used_byo_key GROUP BY 1) s USING (user_id)""")
def ledger_balance(c: Corpus) -> DataFrame:
    return accounts.balances(c.table("events").select("user_id").distinct(), c.grants, c.usage)


@query("SELECT user_id, date_trunc('day', created_utc)::TIMESTAMP AS day, count(*) AS calls, count(*) >= 200 AS capped FROM usage WHERE NOT used_byo_key GROUP BY 1, 2")
def daily_call_cap(c: Corpus) -> DataFrame:
    return accounts.calls_per_day(c.usage)


@query("""WITH b AS (SELECT u.user_id, coalesce(g.x, 0) - coalesce(s.x, 0) AS rest, coalesce(s.n, 0) AS calls FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, sum(amount_micros) AS x FROM grants GROUP BY 1) g USING (user_id)
LEFT JOIN (SELECT user_id, sum(cost_micros) AS x, count(*) AS n FROM usage WHERE NOT used_byo_key GROUP BY 1) s USING (user_id)) SELECT user_id, CASE WHEN calls >= 8 THEN 'daily_cap' WHEN rest <= 0 THEN 'no_budget' ELSE 'allowed' END AS verdict FROM b""")
def budget_gate(c: Corpus) -> DataFrame:
    balance = accounts.balances(c.table("events").select("user_id").distinct(), c.grants, c.usage)
    return accounts.gate(balance, accounts.daily_calls(c.usage, "1970-01-01 00:00:00"), 8).select("user_id", "verdict")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(ceil((event_id % 1000) * CAST(0.25 AS DECIMAL(12,6)) + (event_id % 77) * CAST(1.25 AS DECIMAL(12,6))) AS BIGINT) WHEN event_type = 'purchase' THEN CAST(ceil((event_id % 1000) * CAST(3 AS DECIMAL(12,6)) + (event_id % 77) * CAST(15 AS DECIMAL(12,6))) AS BIGINT) ELSE 0 END AS cost_micros FROM events")
def usage_cost_micros(c: Corpus) -> DataFrame:
    calls = c.table("events").select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000).cast("int").alias("input_tokens"), (F.col("event_id") % 77).cast("int").alias("output_tokens"))
    prices = c.spark.createDataFrame([("click", "0.25", "1.25"), ("purchase", "3", "15")], "model string, price_in string, price_out string")
    return accounts.priced(calls, prices).select("event_id", "cost_micros")


# Table changes


def _page(c: Corpus) -> DataFrame:
    """The next version of the documents: a tenth retitled, twenty new ids; a sixth comes again, later and with another title."""
    old = c.papers.select(F.lit(1).alias("position"), "paper_id", F.when(F.col("paper_id") % 10 == 0, F.concat("title", F.lit(" v2"))).otherwise(F.col("title")).alias("title"), "code_url")
    new = c.spark.range(20).select(F.lit(1).alias("position"), (F.col("id") + 1_000_000_000).alias("paper_id"), F.lit("new").alias("title"), F.lit(None).cast("string").alias("code_url"))
    page = old.where("paper_id % 2 = 0").unionByName(new)
    return page.unionByName(page.where("paper_id % 6 = 0").select(F.lit(2).alias("position"), "paper_id", F.lit("a later title").alias("title"), "code_url"))


_PAGE = """pa AS (SELECT 1 AS position, paper_id, CASE WHEN paper_id % 10 = 0 THEN concat(title, ' v2') ELSE title END AS title, code_url FROM papers WHERE paper_id % 2 = 0 UNION ALL SELECT 1, 1000000000 + r, 'new', NULL FROM range(20) t(r)),
pg AS (SELECT paper_id, title, code_url FROM (SELECT * FROM pa UNION ALL SELECT 2, paper_id, 'a later title', code_url FROM pa WHERE paper_id % 6 = 0) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY position) = 1)"""



@query(f"WITH {_PAGE} SELECT pg.paper_id, CASE WHEN o.paper_id IS NULL THEN 'added' WHEN o.title IS DISTINCT FROM pg.title OR o.code_url IS DISTINCT FROM pg.code_url THEN 'updated' ELSE 'same' END AS change FROM pg LEFT JOIN papers o USING (paper_id)")
def upsert_diff(c: Corpus) -> DataFrame:
    return dml.upsert_diff(c.papers, _page(c), "paper_id", ["title", "code_url"], ["position"])


@query(f"WITH {_PAGE} SELECT paper_id, title, code_url FROM pg UNION ALL SELECT paper_id, title, code_url FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM pg)")
def upsert_table(c: Corpus) -> DataFrame:
    return dml.upsert(c.papers.select("paper_id", "title", "code_url"), _page(c), "paper_id", position=["position"])


@query(f"WITH {_PAGE} SELECT paper_id, title FROM pg WHERE paper_id NOT IN (SELECT paper_id FROM papers)")
def add_only_upsert(c: Corpus) -> DataFrame:
    return dml.add_only(c.papers, _page(c), "paper_id", ["position"]).select("paper_id", "title")


@query("SELECT paper_id, category, 'removed' AS change FROM paper_categories WHERE paper_id % 10 = 0 AND category LIKE 'src%' UNION ALL SELECT paper_id, 'retitled', 'added' FROM papers WHERE paper_id % 10 = 0")
def link_reconcile(c: Corpus) -> DataFrame:
    touched = c.documents.where("doc_id % 10 = 0").select(F.col("doc_id").alias("paper_id"), F.explode(F.array(F.col("lang"), F.lit("retitled"))).alias("category"))
    return dml.reconciled(c.paper_categories, touched, "paper_id", "category")


@query("SELECT interaction_id, CASE WHEN interaction_id % 2 = 0 THEN user_id ELSE 42 END AS user_id FROM interactions")
def owner_claim(c: Corpus) -> DataFrame:
    rows = c.interactions.select("interaction_id", F.when(F.col("interaction_id") % 2 == 0, F.col("user_id")).alias("user_id"))
    return dml.claimed(rows, 42)


@query("SELECT DISTINCT category AS code, concat('Category ', category) AS name FROM paper_categories WHERE category NOT IN ('en', 'fr')")
def ensured_categories(c: Corpus) -> DataFrame:
    wanted = c.paper_categories.select(F.col("category").alias("code"))
    return dml.ensured(c.spark.createDataFrame([("en",), ("fr",)], "code string"), wanted, "code", {"name": F.concat(F.lit("Category "), "code")})


@query("SELECT category, max(published_utc) AS high_water_mark_utc FROM paper_categories JOIN papers USING (paper_id) GROUP BY 1")
def high_water_mark(c: Corpus) -> DataFrame:
    return dml.high_water_marks(c.papers, c.paper_categories)


@query("SELECT event_type AS category, event_id FROM events")
def boundary_refetch_dedupe(c: Corpus) -> DataFrame:
    """Each category was fetched up to a mark, but for half of the boundary's minute; a fetch from the full minute on completes it."""
    events = c.table("events").select(F.col("event_type").alias("category"), "event_id", "ts")
    half = events.agg(F.max("event_id")).first()[0] // 2
    marks = events.where(F.col("event_id") <= half).groupBy("category").agg(F.max("ts").alias("high_water_mark_utc"))
    windows = ingest.fetch_windows(events.select("category").distinct(), marks, AS_OF, 100_000)
    known = events.join(windows, "category").join(marks, "category", "left")
    seen = known.where((F.col("ts") < F.col("since")) | ((F.col("ts") <= F.col("high_water_mark_utc")) & (F.col("event_id") % 2 == 0)))
    return ingest.boundary_refetch(seen.select("category", "event_id", "ts"), events, windows, "event_id", "ts").select("category", "event_id")


# Sets


@query("SELECT coalesce(a.k, b.k) AS category, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM (SELECT lang AS k, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'left', 1) a FULL JOIN (SELECT lang AS k, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY 1) b ON a.k = b.k")
def union_keys_delta(c: Corpus) -> DataFrame:
    a = c.documents.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("left_n")).unionByName(c.spark.createDataFrame([("left", 1)], "category string, left_n long"))
    b = c.documents.where("lang <> 'de'").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("right_n"))
    return a.join(b, "category", "full").select("category", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


@query("SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def intersect_sets(c: Corpus) -> DataFrame:
    return c.documents.where("lang = 'en'").select("source").intersect(c.documents.where("lang = 'de'").select("source"))


@query("SELECT paper_id FROM papers EXCEPT SELECT paper_id FROM signals")
def except_sets(c: Corpus) -> DataFrame:
    return c.papers.select("paper_id").exceptAll(c.signals.select("paper_id"))


@query("SELECT paper_id FROM paper_categories WHERE category = 'fr' UNION SELECT paper_id FROM paper_categories WHERE category = 'src3'")
def union_category_ids(c: Corpus) -> DataFrame:
    ids = lambda code: c.paper_categories.where(F.col("category") == code).select("paper_id")
    return ids("fr").union(ids("src3")).distinct()


@query("SELECT d.doc_id AS id, d.n_chars AS answer FROM documents d")
def positional_zip(c: Corpus) -> DataFrame:
    """Requests and answers in batches, matched by position."""
    rows = c.documents.select("doc_id", "n_chars", F.floor(F.col("doc_id") / 50).alias("b"))
    batches = rows.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("r"))
    return connectors.zipped(batches.select(F.col("r.doc_id").alias("ids"), F.col("r.n_chars").alias("answers")))


# Selections and lists as clients show them


@query("SELECT doc_id FROM documents WHERE CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS TIMESTAMP) >= TIMESTAMP '2024-06-01 00:00:00' AND (lang = 'es' OR source = 'src2')")
def harvest_filter(c: Corpus) -> DataFrame:
    published = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp_ntz")
    entries = c.documents.select("doc_id", F.array("lang", "source").alias("categories"), published.alias("published_utc"))
    return workflow.harvested(entries, ["es", "src2"], "2024-06-01 00:00:00").select("doc_id")


@query(f"SELECT paper_id, published_utc FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM analyses WHERE user_id = 1 AND schema_version >= 2 AND profile_version = 1) AND paper_id IN (SELECT paper_id FROM paper_categories WHERE category IN ('en', 'src4')) AND published_utc >= TIMESTAMP '{AS_OF}' - INTERVAL 300 DAY ORDER BY published_utc DESC, paper_id DESC LIMIT 40")
def stale_selection(c: Corpus) -> DataFrame:
    found = workflow.stale_selection(c.papers, c.paper_categories, c.analyses, 1, 1, AS_OF, categories=("en", "src4"), window_days=300, limit=40)
    return found.select("paper_id", "published_utc")


@query("SELECT paper_id, paper_id IN (SELECT paper_id FROM analyses WHERE user_id = 1 AND schema_version >= 2 AND profile_version = 2) AS fresh FROM papers WHERE paper_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)")
def analysis_status(c: Corpus) -> DataFrame:
    return workflow.analysis_status(c.papers, c.analyses, 1, 2, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, -7])


@query("""WITH r AS (SELECT lang AS query_id, doc_id AS paper_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT query_id, paper_id, 'pool' AS source FROM r WHERE rank <= 50 UNION ALL SELECT lang, doc_id, 'random' FROM documents WHERE doc_id % 9 = 0)
SELECT query_id, paper_id, min(source) AS source FROM b WHERE NOT EXISTS (SELECT 1 FROM judgments j WHERE j.query_id = b.query_id AND j.paper_id = b.paper_id) GROUP BY 1, 2""")
def judge_pool(c: Corpus) -> DataFrame:
    rows = c.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("paper_id"), "n_chars")
    ranked = ranking.ranks(rows, ["query_id"], [F.desc("n_chars"), F.asc("paper_id")])
    return workflow.judge_pool(ranked, rows.where("paper_id % 9 = 0"), c.judgments)


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'fresh' END AS intent, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'new' END AS hyde FROM documents")
def graft_plans(c: Corpus) -> DataFrame:
    key = F.col("doc_id").alias("query_id")
    frozen = c.documents.select(key, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("intent"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("hyde"))
    return workflow.grafted(frozen, c.documents.select(key, F.lit("fresh").alias("intent"), F.lit("new").alias("hyde")), ["intent", "hyde"])


@query("SELECT doc_id, CASE WHEN n <= 30 THEN 'hot' ELSE 'cold' END AS lane FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
def work_lanes(c: Corpus) -> DataFrame:
    return workflow.lanes(c.documents.select("doc_id"), ["doc_id"], 30)


@query("""WITH r AS (SELECT p.paper_id, (p.paper_id % 100) / 100.0 AS score, a.composite_score, row_number() OVER (PARTITION BY p.primary_category ORDER BY (p.paper_id % 100) DESC, p.paper_id) AS rank FROM papers p LEFT JOIN analyses a USING (paper_id))
SELECT paper_id, CAST(rank AS INT) AS rank FROM r WHERE paper_id NOT IN (3, 7) AND composite_score IS NOT NULL""")
def client_result_filter(c: Corpus) -> DataFrame:
    scored = c.papers.select("paper_id", "primary_category", ((F.col("paper_id") % 100) / 100.0).alias("score")).join(c.analyses.select("paper_id", "composite_score"), "paper_id", "left")
    ranked = ranking.ranks(scored, ["primary_category"], [F.desc("score"), F.asc("paper_id")])
    return workflow.shown(ranked, [3, 7], analyzed_only=True).select("paper_id", "rank")


@query("SELECT count(a.paper_id) AS landed, count(*) AS total, count(a.paper_id) * 100 // count(*) AS percent FROM papers LEFT JOIN analyses a USING (paper_id)")
def progress_fraction(c: Corpus) -> DataFrame:
    rows = c.papers.select("paper_id").join(c.analyses.select("paper_id", F.lit(True).alias("done")), "paper_id", "left")
    return workflow.progress(rows.select(F.coalesce("done", F.lit(False)).alias("done")), "done")


@query("SELECT string_agg(l, chr(10) ORDER BY l) AS lines FROM (SELECT DISTINCT concat(lang, ' - ', source) AS l FROM documents)")
def known_category_lines(c: Corpus) -> DataFrame:
    return workflow.known_category_lines(c.documents.select(F.col("lang").alias("code"), F.col("source").alias("name")))


# Feeds: the documents written as XML, and read back by the XML sources


def _escaped(column: F.Column) -> F.Column:
    return F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _as_xml(c: Corpus, name: str, parts: list) -> str:
    path = scratch(c.spark, name)

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each file is a document of its own."""
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], ["value"])
        yield line(f'<{name} xmlns:arxiv="http://arxiv.org/schemas/atom">')
        yield from batches
        yield line(f"</{name}>")

    rows = c.documents.where("text is not null").select(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("value"))
    rows.mapInArrow(rooted, "value string").write.text(path)
    return path


_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"


@query(f"SELECT concat('2401.', CAST(doc_id AS VARCHAR)) AS arxiv_id, CAST(doc_id % 4 + 1 AS INT) AS version, {_CLEAN.format('substr(text, 1, 60)')} AS title, {_CLEAN.format('text')} AS abstract, lang AS primary_category, concat(lang, ' ', source) AS categories, 'Ann Bo; Cy' AS authors FROM documents WHERE doc_id % 10 <> 9")
def xml_atom_entries(c: Corpus) -> DataFrame:
    number = F.col("doc_id").cast("string")
    ident = F.when(F.col("doc_id") % 10 == 9, F.lit("http://arxiv.org/api/errors")).otherwise(F.concat(F.lit("http://arxiv.org/abs/2401."), number, F.lit("v"), (F.col("doc_id") % 4 + 1).cast("string")))
    parts = ["<entry><id>", ident, "</id><title>", _escaped(F.substring("text", 1, 60)), "</title><summary>", _escaped(F.col("text")), "</summary><published>2024-01-05T10:00:00Z</published>", '<author><name>Ann  Bo</name></author><author><name>Cy</name></author><category term="', F.col("source"), '"/><arxiv:primary_category term="', F.col("lang"), '"/></entry>']
    found = xml_feeds.atom_entries(c.spark, _as_xml(c, "feed", parts))
    return found.select("arxiv_id", "version", "title", "abstract", "primary_category", F.array_join("categories", " ").alias("categories"), text.joined_authors(F.col("authors")).alias("authors"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, {_CLEAN.format('substr(text, 1, 60)')} AS title, source AS primary_category, concat(source, ' ', lang) AS categories, 'Marie Curie; Plato' AS authors, TIMESTAMP '2024-01-02 00:00:00' AS updated_utc, '10.1/a' AS doi FROM documents WHERE doc_id % 7 <> 0")
def xml_oai_records(c: Corpus) -> DataFrame:
    status = F.when(F.col("doc_id") % 7 == 0, F.lit(' status="deleted"')).otherwise(F.lit(""))
    parts = ["<record><header", status, "><identifier>x</identifier></header><metadata><arXiv><id>", F.col("doc_id").cast("string"), "</id><created>2024-01-02</created><authors><author><keyname>Curie</keyname><forenames>Marie</forenames></author><author><keyname>Plato</keyname></author></authors><title>", _escaped(F.substring("text", 1, 60)), "</title><categories>", F.col("source"), "  ", F.col("lang"), "</categories><doi>10.1/a 10.2/b</doi><abstract>x</abstract></arXiv></metadata></record>"]
    found = xml_feeds.oai_records(c.spark, _as_xml(c, "ListRecords", parts))
    return found.select("arxiv_id", "title", "primary_category", F.array_join("categories", " ").alias("categories"), text.joined_authors(F.col("authors")).alias("authors"), "updated_utc", "doi")


# Streams


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1")
def stream_delta_upsert(c: Corpus) -> DataFrame:
    """The events as a stream of pages, merged by user; the newest event of each user stays."""
    spark = c.spark
    base = scratch(spark, "stream")
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType())])
    pages = c.table("events").select("user_id", "event_id")
    pages.repartition(4, "event_id").write.parquet(f"{base}/pages")

    stream = ingest.merge_stream(spark, f"{base}/pages", schema, f"{base}/table", f"{base}/checkpoint", "user_id", "event_id", 2, newest=["event_id"], compact_every=2)
    stream.awaitTermination()
    return ingest.current(spark, f"{base}/table", schema, "user_id", ["event_id"])
