"""Browsing: filtered, sorted and paged papers, their nested rows, counts by category, selections for analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import filters

SORTS = {
    "newest": lambda: [F.desc("published_utc"), F.desc("paper_id")],
    "oldest": lambda: [F.asc("published_utc"), F.asc("paper_id")],
    "score": lambda: [F.asc(F.col("analyzed").isNull()), F.desc_nulls_first("composite_score"), F.desc("published_utc"), F.desc("paper_id")],
}


def own_analyses(analyses: DataFrame, user_id: int | None) -> DataFrame:
    mine = analyses.where(F.col("user_id").eqNullSafe(F.lit(user_id).cast("long")))
    return mine.select("paper_id", "composite_score", F.lit(True).alias("analyzed"))


def browse(papers: DataFrame, paper_categories: DataFrame, analyses: DataFrame | None = None, bookmarks: DataFrame | None = None, *, categories: Sequence[str] = (), window_days: int | None = None, as_of: str, user_id: int | None = None, analyzed_only: bool = False, bookmarked_only: bool = False, sort: str = "newest") -> DataFrame:
    """All papers that match, in order; `page` cuts one page out."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    found = filters.in_window(filters.any_category(papers, paper_categories, categories), window_days, as_of)
    if analyzed_only:
        found = filters.owned_by(analyses, found, user_id)
    if bookmarked_only:
        found = filters.owned_by(bookmarks, found, user_id)
    if sort == "score":
        found = found.join(own_analyses(analyses, user_id), "paper_id", "left")
    return found.orderBy(*SORTS[sort]())


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered result."""
    number, size = filters.checked_page(number, size)
    return ordered.offset((number - 1) * size).limit(size)


def page_counts(found: DataFrame, size: int) -> DataFrame:
    """total and total_pages, which is 0 for no rows."""
    return found.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).alias("total_pages"))


def nested(papers: DataFrame, paper_categories: DataFrame, analyses: DataFrame, bookmarks: DataFrame, user_id: int | None) -> DataFrame:
    """papers with their sorted categories, the user's analysis and whether the user bookmarked them."""
    codes = paper_categories.groupBy("paper_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    marked = bookmarks.where(F.col("user_id") == F.lit(user_id).cast("long")).select("paper_id", F.lit(True).alias("_marked")).distinct()
    joined = papers.join(codes, "paper_id", "left").join(own_analyses(analyses, user_id), "paper_id", "left").join(marked, "paper_id", "left")
    analysis = F.when(F.col("analyzed"), F.struct("composite_score"))
    return joined.select(*papers.columns, "categories", analysis.alias("analysis"), F.coalesce("_marked", F.lit(False)).alias("is_bookmarked"))


def hydrate(ranked: DataFrame, papers: DataFrame) -> DataFrame:
    """Ranked ids with their papers, in rank order; ids without a paper go."""
    return ranked.join(papers, "paper_id").orderBy("rank")


def category_counts(paper_categories: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, paper_count) for every code, zero included."""
    per = paper_categories.groupBy("category").agg(F.count("*").alias("n"))
    return codes.join(per, codes["code"] == per["category"], "left").select("code", F.coalesce("n", F.lit(0)).alias("paper_count"))


def coverage(paper_categories: DataFrame, analyses: DataFrame, user_id: int | None) -> DataFrame:
    """(category, total, analyzed) with the user's analyses."""
    mine = own_analyses(analyses, user_id).select("paper_id", "analyzed").distinct()
    return paper_categories.join(mine, "paper_id", "left").groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.coalesce("analyzed", F.lit(False))).alias("analyzed"))


def newest(found: DataFrame, limit: int) -> DataFrame:
    return found.orderBy(F.desc("published_utc"), F.desc("paper_id")).limit(limit)


def in_caller_order(found: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The papers that a caller names, in the caller's order and once each; unknown ids go."""
    asked = found.sparkSession.createDataFrame([(list(ids),)], "ids array<long>").select(F.posexplode("ids").alias("position", "paper_id"))
    first = asked.groupBy("paper_id").agg(F.min("position").alias("position"))
    return found.join(first, "paper_id").orderBy("position")


def recent_searches(logged: DataFrame, limit: int) -> DataFrame:
    """The newest search of each normalised text, newest first. logged: (search_id, created, query_text)."""
    newest_first = F.row_number().over(W.partitionBy("key").orderBy(F.desc("created"), F.desc("search_id")))
    keyed = logged.withColumn("key", text.normalized_query(F.col("query_text"))).where("key <> ''").withColumn("n", newest_first)
    return keyed.where("n = 1").orderBy(F.desc("created"), F.desc("search_id")).limit(limit).drop("n")


def replay(slots: DataFrame, searches: DataFrame, search_id: int, user_id: int, papers: DataFrame) -> DataFrame:
    """The papers that a search of the user's showed, in rank order; nothing if the search is another user's."""
    own = searches.where((F.col("search_event_id") == search_id) & (F.col("user_id") == user_id)).select("search_event_id")
    return hydrate(slots.join(own, "search_event_id", "left_semi"), papers)
