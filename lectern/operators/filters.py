"""Plans and the filters they ask for, as DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dates


@dataclass(frozen=True)
class Plan:
    """What a search asks for. An empty list of categories, no window and require_no_code=False ask for nothing."""

    anchor_text: str = ""
    categories: tuple[str, ...] = ()
    date_window_days: int | None = None
    require_no_code: bool = False
    interpretation: str = ""
    hypothetical_abstract: str | None = None
    intent: str | None = None


def checked_limit(limit: int, most: int = 200) -> int:
    """A limit held between 1 and most."""
    return max(1, min(limit, most))


def checked_page(page: int, size: int, most: int = 100) -> tuple[int, int]:
    """Page and page size; a page below 1 or a size out of 1..most is an error."""
    if page < 1 or not 1 <= size <= most:
        raise ValueError(f"page must be 1 or more and the page size from 1 to {most}")
    return page, size


def any_category(papers: DataFrame, paper_categories: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Papers in at least one of the categories; all papers if none is given, none if no paper bears any of them."""
    if not categories:
        return papers
    wanted = paper_categories.where(F.col("category").isin(list(categories))).select("paper_id")
    return papers.join(wanted, "paper_id", "left_semi")


def in_window(papers: DataFrame, days: int | None, as_of: str) -> DataFrame:
    """Published at the cutoff or later, to the microsecond; all papers without a window above zero."""
    return papers.where(F.col("published_utc") >= dates.cutoff(as_of, days)) if days and days > 0 else papers


def in_window_days(papers: DataFrame, days: int | None, as_of: str) -> DataFrame:
    """As in_window, but by whole days: the cutoff's day counts in full."""
    if not days or days <= 0:
        return papers
    return papers.where(dates.epoch_day(F.col("published_utc")) >= dates.epoch_day(dates.cutoff(as_of, days)))


def without_code(papers: DataFrame, wanted: bool = True) -> DataFrame:
    return papers.where(F.col("code_url").isNull()) if wanted else papers


def candidates(papers: DataFrame, paper_categories: DataFrame, plan: Plan, as_of: str) -> DataFrame:
    """All filters of a plan; the window's cutoff is exact."""
    kept = without_code(in_window(papers, plan.date_window_days, as_of), plan.require_no_code)
    return any_category(kept, paper_categories, plan.categories)


def index_gate(papers: DataFrame, paper_categories: DataFrame, plan: Plan, as_of: str) -> DataFrame:
    """The papers that index scans may return: the candidates, or by whole days if only a window is asked for."""
    if plan.categories or plan.require_no_code:
        return candidates(papers, paper_categories, plan, as_of)
    return in_window_days(papers, plan.date_window_days, as_of)


def owned_by(rows: DataFrame, papers: DataFrame, user_id: int | None) -> DataFrame:
    """Papers for which rows has one of the user's; no user matches rows without an owner."""
    own = rows.where(F.col("user_id").eqNullSafe(F.lit(user_id).cast("long"))).select("paper_id")
    return papers.join(own, "paper_id", "left_semi")


def stale(papers: DataFrame, analyses: DataFrame, user_id: int | None, profile_version: int, schema_version: int = 2) -> DataFrame:
    """Papers without an analysis of the user's current profile in this schema version or a later one."""
    fresh = analyses.where(F.col("user_id").eqNullSafe(F.lit(user_id).cast("long")) & (F.col("schema_version") >= schema_version) & (F.col("profile_version") == profile_version))
    return papers.join(fresh.select("paper_id"), "paper_id", "left_anti")


def needs_embedding(papers: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """Papers without a vector of the model."""
    have = embeddings if model is None else embeddings.where(F.col("model_version") == model)
    return papers.join(have.select("paper_id"), "paper_id", "left_anti")


def stale_signals(papers: DataFrame, signals: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Papers whose signals are missing or were fetched before the cutoff."""
    joined = papers.join(signals.select("paper_id", "fetched_utc"), "paper_id", "left")
    return joined.where(F.col("fetched_utc").isNull() | (F.col("fetched_utc") < dates.cutoff(as_of, days))).drop("fetched_utc")


def awaiting_stars(papers: DataFrame, signals: DataFrame) -> DataFrame:
    """Papers with a GitHub link and a signal row that has no stars yet."""
    return papers.where(F.col("code_url").contains("github.com")).join(signals.where("github_stars is null").select("paper_id"), "paper_id")


def holds_either(term: str, *columns: str) -> Column:
    """LIKE %term% on any of some columns; wildcards in the term keep their meaning."""
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).like(f"%{term}%")
    return found


def text_search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows of which a column holds the needle, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.col(c)).contains(needle.lower())
    return rows.where(found)


def named_categories(codes: DataFrame, stored: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """codes (code) with name: the stored one unless it is the code itself, else the taxonomy's, else that of its archive
    (the part before the full stop), else the code."""
    own = stored.select("code", F.col("name").alias("_own"))
    fixed = taxonomy.select("code", F.col("name").alias("_fixed"))
    archive = taxonomy.select(F.col("code").alias("_archive"), F.col("name").alias("_wide"))
    name = F.coalesce(F.when(F.col("_own") != F.col("code"), F.col("_own")), F.col("_fixed"), F.col("_wide"), F.col("code"))
    keyed = codes.withColumn("_archive", F.substring_index("code", ".", 1))
    return keyed.join(own, "code", "left").join(fixed, "code", "left").join(archive, "_archive", "left").select(*codes.columns, name.alias("name"))
