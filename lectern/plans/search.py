"""Hybrid search: filters, dense and lexical scans, fusion, optional blending and reranking, slots, nested rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dates
from lectern.operators import dense, dense_many, filters, lexical, ranking
from lectern.operators.filters import Plan
from lectern.operators.lexical import LexicalIndex
from lectern.tables import stored


@dataclass(frozen=True)
class SearchOptions:
    """hybrid: words as well as vectors. weights: of ranking.blend, None to leave the order. rerank: scorer of the head's papers.

    index: a stored one of the papers' words; without, the papers are parsed.
    """

    limit: int = 50
    hybrid: bool = True
    weights: dict | None = None
    rerank: Column | None = None
    rerank_depth: int = 100
    index: LexicalIndex | None = None


def _scored(embeddings: DataFrame, allowed: DataFrame, anchors: list[list[float]], experience: list[float] | None) -> DataFrame:
    """The allowed papers' scores; vectors of other papers aren't touched."""
    return dense.anchor_scores(dense.restricted(embeddings, allowed), anchors, experience)


def _pool(papers: DataFrame, signals: DataFrame, scored: DataFrame, allowed: DataFrame, plan: Plan, as_of: str, options: SearchOptions) -> DataFrame:
    size = ranking.pool_size(filters.checked_limit(options.limit))
    near = dense.top(scored, size).select("paper_id", "score", "rank")
    if options.hybrid:
        query = papers.sparkSession.createDataFrame([(1, plan.anchor_text)], "query_id long, query_text string")
        words = lexical.bm25(papers, query, size, allowed) if options.index is None else lexical.search_index(options.index, query, size, allowed)
        near = ranking.fuse(near, words.select("paper_id", "rank"), scored.select("paper_id", "best"), size).select("paper_id", "score", "rank")
    if options.weights:
        near = ranking.ranked_by_blend(ranking.blend(near.drop("rank"), papers, signals, as_of, **options.weights)).select("paper_id", "score", "rank")
    if options.rerank is not None:
        near = ranking.rerank_head(near.join(papers, "paper_id"), options.rerank_depth, options.rerank).select("paper_id", "score", F.col("new_rank").alias("rank"))
    return near


def pool(papers: DataFrame, paper_categories: DataFrame, signals: DataFrame, embeddings: DataFrame, plan: Plan, anchors: list[list[float]], as_of: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(paper_id, score, rank): the ranked pool from which slots are filled. score stays the cosine whatever sets the order."""
    allowed = filters.index_gate(papers, paper_categories, plan, as_of).select("paper_id")
    return _pool(papers, signals, _scored(embeddings, allowed, anchors, None), allowed, plan, as_of, options)


def search(papers: DataFrame, paper_categories: DataFrame, signals: DataFrame, embeddings: DataFrame, plan: Plan, anchors: list[list[float]], as_of: str, experience: list[float] | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(paper_id, rank, score, is_wildcard, proximity), best first. Without candidates there are no rows."""
    limit = filters.checked_limit(options.limit)
    allowed = filters.index_gate(papers, paper_categories, plan, as_of).select("paper_id")
    scored = _scored(embeddings, allowed, anchors, experience)
    ranked = _pool(papers, signals, scored, allowed, plan, as_of, options)
    if experience is None:
        slots = ranking.select_slots(ranked, limit, None)
        return slots.withColumn("proximity", F.lit(None).cast("string")).select("paper_id", "rank", "score", "is_wildcard", "proximity").orderBy("rank")
    known = scored.select("paper_id", F.col("e").alias("score"))
    slots = ranking.select_slots(ranked, limit, known)
    near = slots.join(known.select("paper_id", F.col("score").alias("e")), "paper_id", "left")
    return near.select("paper_id", "rank", "score", "is_wildcard", ranking.proximity(F.col("e")).alias("proximity")).orderBy("rank")


QUICK_DAYS = 365


def quick_search(papers: DataFrame, paper_categories: DataFrame, signals: DataFrame, embeddings: DataFrame, prose: str, anchors: list[list[float]], as_of: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """A first answer while a plan is compiled: the prose is the anchor, over the last year. It is never logged."""
    return search(papers, paper_categories, signals, embeddings, Plan(anchor_text=prose, date_window_days=QUICK_DAYS), anchors, as_of, None, options)


def gates(plans: DataFrame, as_of: str) -> DataFrame:
    """plans (query_id, anchor_text, categories, date_window_days, require_no_code) with wanted, since, since_us and no_code: what
    index_gate lets through, as values of a row. A window alone counts by whole days, with another filter to the microsecond."""
    none = F.array().cast("array<string>")
    some = (F.size(F.coalesce("categories", none)) > 0) | F.coalesce("require_no_code", F.lit(False))
    exact = dates.moment(as_of) - F.make_dt_interval(F.col("date_window_days"))
    since = F.when(F.col("date_window_days") > 0, F.when(some, exact).otherwise(dates.day_of(exact)))
    rows = plans.select("query_id", "anchor_text", F.coalesce("categories", none).alias("wanted"), since.alias("since"), F.coalesce("require_no_code", F.lit(False)).alias("no_code"))
    return rows.withColumn("since_us", dates.micros(F.col("since")))


def search_many(papers: DataFrame, paper_categories: DataFrame, signals: DataFrame, embeddings: DataFrame, plans: DataFrame, anchors: DataFrame, as_of: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """(query_id, paper_id, rank, score, is_wildcard, proximity): search for every row of plans at once, in a fixed number of jobs.

    plans (query_id, anchor_text, categories, date_window_days, require_no_code); anchors (query_id, kind, vector): the primary
    one, topics and at most one experience of each plan (dense_many.PRIMARY, TOPIC, EXPERIENCE). Gates are tested on what a scan
    meets: on papers' vectors block by block, on papers that share a word before they are ranked. Each plan's rows are those of
    search; a plan without an experience has no wildcards and no proximity, and one without candidates no rows.
    """
    limit = filters.checked_limit(options.limit)
    size, keys = ranking.pool_size(limit), ["query_id", "paper_id"]
    asked = gates(plans, as_of)
    known = anchors.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("kind", "vector"))).alias("a"))
    asked = stored(asked.join(known, "query_id").select(*asked.columns, F.col("a.kind").alias("kinds"), F.col("a.vector").alias("anchors")), "searches")
    tags = paper_categories.groupBy("paper_id").agg(F.collect_set("category").alias("categories"))
    facts = papers.select("paper_id", "published_utc", F.col("code_url").isNotNull().alias("coded")).join(tags, "paper_id", "left")
    scanned = dense.scanned(embeddings).join(facts, "paper_id").withColumn("published_us", dates.micros(F.col("published_utc"))).drop("published_utc")
    near = stored(dense_many.top_many(scanned, asked.select("query_id", "kinds", "anchors", "since_us", "no_code", "wanted"), size), "near")
    pool = near.select(*keys, "score", "rank")
    if options.hybrid:
        queries = asked.select("query_id", F.col("anchor_text").alias("query_text"))
        sums = lexical.bm25(papers, queries, None) if options.index is None else lexical.search_sums(options.index, queries)
        open_ = F.col("since").isNull() & ~F.col("no_code") & (F.size("wanted") == 0)
        free = sums.join(asked.where(open_).select("query_id"), "query_id", "left_semi").select(*keys, "score")
        gate = asked.where(~open_).select("query_id", "since", "no_code", "wanted")
        passed = (F.col("since").isNull() | (F.col("published_utc") >= F.col("since"))) & ~(F.col("no_code") & F.col("coded")) & ((F.size("wanted") == 0) | F.coalesce(F.arrays_overlap("wanted", "categories"), F.lit(False)))
        held = sums.join(gate, "query_id").join(facts, "paper_id").where(passed).select(*keys, "score")
        words = lexical.best_of(free.unionByName(held), size)
        fused = stored(ranking.fuse_many(pool, words, size), "fused")
        lone = dense_many.pair_scores(fused.where("score is null"), embeddings, asked)
        near = near.select(*keys, "best", "e").unionByName(lone.select(*keys, "best", "e"))
        pool = fused.join(lone.select(*keys, "best"), keys, "left").select(*keys, F.coalesce("score", "best", F.lit(0.0)).alias("score"), "rank")
    if options.weights:
        pool = ranking.ranked_by_blend(ranking.blend(pool.drop("rank"), papers, signals, as_of, **options.weights), ["query_id"]).select(*keys, "score", "rank")
    if options.rerank is not None:
        pool = ranking.rerank_head(pool.join(papers, "paper_id"), options.rerank_depth, options.rerank, ["query_id"]).select(*keys, "score", F.col("new_rank").alias("rank"))
    own = asked.where(F.array_contains("kinds", dense_many.EXPERIENCE)).select("query_id")
    experienced = near.join(own, "query_id", "left_semi").select(*keys, F.col("e").alias("score"))
    slots = ranking.select_slots(pool.join(own, "query_id", "left_semi"), limit, experienced, ["query_id"])
    plain = ranking.select_slots(pool.join(own, "query_id", "left_anti"), limit, None, ["query_id"])
    every = slots.unionByName(plain).join(experienced.select(*keys, F.col("score").alias("e")), keys, "left")
    return every.select(*keys, "rank", "score", "is_wildcard", ranking.proximity(F.col("e")).alias("proximity"))


def interleaved_search(control: DataFrame, candidate: DataFrame, search_id: int, limit: int, seed: int = 0) -> DataFrame:
    """(rank, paper_id, variant): two searches of one request (paper_id, rank), drafted in turn, so that votes compare them."""
    side = lambda found, variant: found.select(F.lit(search_id).cast("long").alias("search_id"), F.lit(variant).alias("variant"), "rank", "paper_id")
    return ranking.team_draft(side(control, "A").unionByName(side(candidate, "B")), limit, seed).select("rank", "paper_id", "variant")


def candidate_count(papers: DataFrame, paper_categories: DataFrame, plan: Plan, as_of: str) -> DataFrame:
    return filters.candidates(papers, paper_categories, plan, as_of).agg(F.count("*").alias("total_candidates"))
