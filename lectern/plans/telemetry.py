"""Bias report over logged searches as small tables, adoption of logged queries, weights on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import dates, text

HEAD = 10


def head_papers(slots: DataFrame, papers: DataFrame) -> DataFrame:
    """Slots of the first ranks with their papers."""
    return slots.where(F.col("rank") <= HEAD).join(papers.select("paper_id", "primary_category", "published_utc", "abstract"), "paper_id")


def shown_share(head: DataFrame) -> DataFrame:
    """(category, shown): each category's share of the head."""
    counts = head.groupBy(F.col("primary_category").alias("category")).agg(F.count("*").alias("n"))
    return counts.select("category", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("shown"))


def pool_share(events: DataFrame, plan_candidates: DataFrame) -> DataFrame:
    """(category, pool): mean over logged searches of a category's share of the plan's candidates.

    events: (plan_id) for each search. plan_candidates: (plan_id, paper_id, category) for each distinct plan. A plan is
    computed once, and weighs as often as it was used; plans without candidates are left out.
    """
    per = plan_candidates.groupBy("plan_id", "category").agg(F.count("*").alias("n"))
    share = per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("plan_id")))
    used = events.groupBy("plan_id").agg(F.count("*").alias("uses")).join(per.select("plan_id").distinct(), "plan_id", "left_semi")
    weight = used.withColumn("weight", F.col("uses") / F.sum("uses").over(W.partitionBy()))
    return share.join(weight, "plan_id").groupBy("category").agg(F.sum(F.col("share") * F.col("weight")).alias("pool"))


def category_deltas(shown: DataFrame, pool: DataFrame, top: int | None = 8) -> DataFrame:
    """(category, shown, pool, delta), the widest gaps first; a side that lacks a category has 0."""
    both = shown.join(pool, "category", "full").select("category", F.coalesce("shown", F.lit(0.0)).alias("shown"), F.coalesce("pool", F.lit(0.0)).alias("pool"))
    ordered = both.withColumn("delta", F.col("shown") - F.col("pool")).orderBy(F.desc(F.round(F.abs("delta"), 9)), "category")
    return ordered if top is None else ordered.limit(top)


def skew(head: DataFrame, events: DataFrame, plan_candidates: DataFrame, as_of: str) -> DataFrame:
    """One row: mean age in days and abstract length of the head, and of the plans' candidates over searches; null without rows."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("published_utc"), dates.moment(as_of)) / F.lit(1e6)
    age, length = seconds / 86400.0, F.length("abstract")
    shown = head.agg(F.avg(age).alias("shown_age"), F.avg(length).alias("shown_length"))
    per = plan_candidates.groupBy("plan_id").agg(F.avg(age).alias("age"), F.avg(length).alias("length"))
    pool = events.join(per, "plan_id").agg(F.avg("age").alias("pool_age"), F.avg("length").alias("pool_length"))
    return shown.join(F.broadcast(pool))  # one row each


def comfort_zone(head: DataFrame) -> DataFrame:
    """Whole percentages of the head that are close, a stretch or neither, wildcards apart; null without rows."""
    rows = head.where("not is_wildcard").agg(F.count("*").alias("n"), F.count_if(F.col("proximity") == "close").alias("close"), F.count_if(F.col("proximity") == "stretch").alias("stretch"))
    percent = lambda x: F.expr(f"({x}) * 100 div nullif(n, 0)")
    return rows.select("n", percent("close").alias("close_percent"), percent("stretch").alias("stretch_percent"), percent("n - close - stretch").alias("neutral_percent"))


def wildcard_yield(slots: DataFrame, interactions: DataFrame) -> DataFrame:
    """Wildcards and other slots shown, interactions with each, and their rates (0 where none was shown)."""
    shown = slots.agg(F.count_if("is_wildcard").alias("wild"), F.count_if(~F.col("is_wildcard")).alias("plain"))
    keys = slots.where("is_wildcard").select("search_event_id", "paper_id").distinct().withColumn("hit", F.lit(True))
    acts = interactions.where("search_event_id is not null").join(keys, ["search_event_id", "paper_id"], "left")
    hits = acts.agg(F.count_if(F.col("hit").isNotNull()).alias("wild_hits"), F.count_if(F.col("hit").isNull()).alias("plain_hits"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return shown.join(F.broadcast(hits)).select("wild", "wild_hits", "plain", "plain_hits", rate("wild_hits", "wild").alias("wild_yield"), rate("plain_hits", "plain").alias("plain_yield"))


def positions(interactions: DataFrame) -> DataFrame:
    """Where interactions with a search's paper fall, and whether nine in ten of at least ten are in the top three."""
    own = F.col("search_event_id").isNotNull()
    count = lambda c: F.count_if(own & c)
    rank = F.col("rank")
    rows = interactions.agg(F.count_if(own).alias("n"), count((rank >= 1) & (rank <= 3)).alias("top3"), count((rank >= 4) & (rank <= 10)).alias("mid"), count(rank > 10).alias("tail"), count(rank.isNull()).alias("unresolved"), F.count_if(~own).alias("without_search"))
    return rows.withColumn("warns", (F.col("n") >= 10) & (F.col("top3") >= F.expr("n * 9 div 10")))


def interleaving_votes(slots: DataFrame, interactions: DataFrame) -> DataFrame:
    """(variant, slots, votes). Of slots that repeat a search and paper, the one with the smallest rank counts for votes."""
    shown = slots.where("variant is not null").groupBy("variant").agg(F.count("*").alias("slots"))
    first = slots.where("variant is not null").groupBy("search_event_id", "paper_id").agg(F.min_by("variant", "rank").alias("variant"))
    votes = interactions.where("search_event_id is not null").join(first, ["search_event_id", "paper_id"]).groupBy("variant").agg(F.count("*").alias("votes"))
    return shown.join(votes, "variant", "left").select("variant", "slots", F.coalesce("votes", F.lit(0)).alias("votes"))


def adopt(logged: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(query_id, query_text, plan, uses) for each text that was searched for and that known (query_text) lacks.

    The newest plan and spelling count. Ids are slugs; further ones of a slug end in -2, -3 and so on, oldest text first.
    logged: (query_text, plan, created), created distinct.
    """
    rows = logged.withColumn("key", text.normalized_query(F.col("query_text"))).where("key <> ''")
    if known is not None:
        rows = rows.join(known.select(text.normalized_query(F.col("query_text")).alias("key")), "key", "left_anti")
    best = rows.groupBy("key").agg(F.max_by(F.struct("query_text", "plan"), "created").alias("b"), F.count("*").alias("uses"))
    named = best.withColumn("slug", text.slug(F.col("key")))
    place = F.row_number().over(W.partitionBy("slug").orderBy("key"))
    query_id = F.when(place == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), place.cast("string")))
    return named.select(query_id.alias("query_id"), F.col("b.query_text").alias("query_text"), F.col("b.plan").alias("plan"), "uses")


def bookmarks(interactions: DataFrame) -> DataFrame:
    """(user_id, paper_id, created_utc) as the log leaves them: the last event of each user and paper decides, so setting or
    removing a bookmark twice changes nothing."""
    last = F.row_number().over(W.partitionBy("user_id", "paper_id").orderBy(F.desc("acted_utc"), F.desc("interaction_id")))
    acts = interactions.where("type in ('Bookmarked', 'Unbookmarked')").withColumn("n", last)
    return acts.where("n = 1 and type = 'Bookmarked'").select("user_id", "paper_id", F.col("acted_utc").alias("created_utc"))


def resolved_ranks(interactions: DataFrame, slots: DataFrame) -> DataFrame:
    """Interactions with a search but no rank take the rank that the search logged for the paper; null if it showed none."""
    first = slots.groupBy("search_event_id", "paper_id").agg(F.min("rank").alias("_logged"))
    joined = interactions.join(first, ["search_event_id", "paper_id"], "left")
    return joined.select(*[c for c in interactions.columns if c != "rank"], F.coalesce("rank", "_logged").alias("rank"))


def logged_slots(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits (search_event_id, position, arxiv_id) as rows to log. Unknown papers go, but use up their rank. Of papers with one arxiv_id
    the smallest id is logged, so a hit is a row."""
    papers = papers.groupBy("arxiv_id").agg(F.min("paper_id").alias("paper_id"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("search_event_id").orderBy("position")))
    return ranked.join(papers, "arxiv_id").select("search_event_id", "rank", "paper_id")


def weight_grid(spark: SparkSession, recencies: tuple, codes: tuple, citations: tuple) -> DataFrame:
    """(config_id, w_recency, w_code, w_citations) for each combination; as many rows as the caller's lists allow."""
    rows = [(n, float(a), float(b), float(c)) for n, (a, b, c) in enumerate((a, b, c) for a in recencies for b in codes for c in citations)]
    return spark.createDataFrame(rows, "config_id int, w_recency double, w_code double, w_citations double")
