"""What surrounds search and evaluation: selections for analysis, judge pools, grafted plans, invites, lists as a client shows them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import dates
from lectern.operators import filters
from lectern.plans import browse


def harvested(entries: DataFrame, categories: Sequence[str], since: str) -> DataFrame:
    """Harvested entries (categories array, published_utc) to keep: from a day on, in any configured category."""
    wanted = F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>")
    return entries.where((F.col("published_utc") >= dates.moment(since)) & F.arrays_overlap("categories", wanted))


def stale_selection(papers: DataFrame, paper_categories: DataFrame, analyses: DataFrame, user_id: int | None, profile_version: int, as_of: str, *, categories: Sequence[str] = (), window_days: int | None = None, ids: Sequence[int] | None = None, limit: int = 50) -> DataFrame:
    """Papers to analyse: of an explicit list in its order, or of a sweep over categories the newest, without fresh ones."""
    open_ = filters.stale(papers, analyses, user_id, profile_version)
    if ids is not None:
        return browse.in_caller_order(open_, ids)
    return browse.newest(filters.in_window(filters.any_category(open_, paper_categories, categories), window_days, as_of), limit)


def analysis_status(papers: DataFrame, analyses: DataFrame, user_id: int | None, profile_version: int, ids: Sequence[int]) -> DataFrame:
    """(paper_id, fresh) for the papers that a caller names."""
    named = papers.where(F.col("paper_id").isin(list(ids))).select("paper_id")
    waiting = filters.stale(named, analyses, user_id, profile_version).select("paper_id", F.lit(False).alias("_fresh"))
    return named.join(waiting, "paper_id", "left").select("paper_id", F.coalesce("_fresh", F.lit(True)).alias("fresh"))


def judge_pool(ranked: DataFrame, sample: DataFrame, judged: DataFrame, head: int = 50) -> DataFrame:
    """(query_id, paper_id, source) still to judge: the heads of rankings and a random sample; a paper in both is of the pool."""
    both = ranked.where(F.col("rank") <= head).select("query_id", "paper_id", F.lit("pool").alias("source")).unionByName(sample.select("query_id", "paper_id", F.lit("random").alias("source")))
    return both.groupBy("query_id", "paper_id").agg(F.min("source").alias("source")).join(judged.select("query_id", "paper_id"), ["query_id", "paper_id"], "left_anti")


def grafted(frozen: DataFrame, fresh: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Frozen plans (query_id, fields) whose missing fields are taken from fresh ones; fields that are there stay."""
    new = fresh.select("query_id", *(F.col(f).alias(f"_{f}") for f in fields))
    return frozen.join(new, "query_id", "left").select("query_id", *(F.coalesce(f, f"_{f}").alias(f) for f in fields))


def redeemable(invites: DataFrame, as_of: str) -> Column:
    """Invites that can still be used: not used up and not expired."""
    return (F.col("used") < F.col("max_uses")) & (F.col("expires_utc").isNull() | (F.col("expires_utc") > dates.moment(as_of)))


def redeemed(invites: DataFrame, users: DataFrame, claims: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(invites, users) after claims (user_id, code), at most one for each code: inactive users become active, codes count up."""
    good = claims.join(invites.where(redeemable(invites, as_of)).select("code"), "code").join(users.where("not is_active").select("user_id"), "user_id")
    used = invites.join(good.select("code", F.lit(1).alias("_n")), "code", "left").withColumn("used", F.col("used") + F.coalesce("_n", F.lit(0))).select(*invites.columns)
    active = users.join(good.select("user_id", F.lit(True).alias("_on")), "user_id", "left").withColumn("is_active", F.coalesce("_on", "is_active")).select(*users.columns)
    return used, active


def lanes(work: DataFrame, order: Sequence[str], first: int) -> DataFrame:
    """work with lane: the first items are worked on at once (hot), the rest are queued (cold)."""
    hot = work.orderBy(*order).limit(first).select(*order, F.lit("hot").alias("_lane"))
    return work.join(hot, list(order), "left").withColumn("lane", F.coalesce("_lane", F.lit("cold"))).drop("_lane")


def shown(ranked: DataFrame, hidden: Sequence[int] = (), analyzed_only: bool = False) -> DataFrame:
    """A ranked list as a client filters it; ranks are those of the whole list."""
    kept = ranked.where(~F.col("paper_id").isin(list(hidden))) if hidden else ranked
    return kept.where("composite_score is not null") if analyzed_only else kept


def by_score(ranked: DataFrame) -> list[Column]:
    """The client's order: analysis score, missing ones last, then match."""
    return [F.desc(F.coalesce("composite_score", F.lit(-1.0))), F.desc("score"), F.asc("paper_id")]


def progress(items: DataFrame, landed: str) -> DataFrame:
    """landed and total items, and the whole percentage; 0 for none."""
    rows = items.agg(F.count_if(F.col(landed)).alias("landed"), F.count("*").alias("total"))
    return rows.withColumn("percent", F.coalesce(F.expr("landed * 100 div nullif(total, 0)"), F.lit(0).cast("long")))


def known_category_lines(codes: DataFrame) -> DataFrame:
    """One text with a line "code - name" for each distinct code, in order: what a plan compiler is told of the corpus."""
    lines = F.array_sort(F.collect_set(F.concat_ws(" - ", "code", "name")))
    return codes.agg(F.array_join(lines, "\n").alias("lines"))


def prefixed_query(text: Column, prefix: str) -> Column:
    """A query as an embedding model gets it; documents and hypothetical abstracts go without the prefix."""
    return F.concat(F.lit(prefix), text)


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ingestion runs, the larger id first at equal times."""
    return runs.orderBy(F.desc("started_utc"), F.desc("run_id")).limit(limit)
