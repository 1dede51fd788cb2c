"""Fusing, blending, reordering and annotating ranked lists; pools are bounded by the caller's limit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import dates
from lectern.tables import stored

RRF_K = 60
WILDCARD_SLOTS = 2
CLOSE, STRETCH = 0.45, 0.25


def pool_size(limit: int) -> int:
    return max(5 * limit, limit + 50)


def fuse(dense: DataFrame, lexical: DataFrame, best: DataFrame, top: int) -> DataFrame:
    """(paper_id, score, rrf, rank) from ranked lists dense (paper_id, score, rank) and lexical (paper_id, rank).

    Order is by the sum of 1 / (60 + rank); at equal sums dense papers come first, in their order. score stays the
    cosine: that of dense, or best (paper_id, best) for papers found by words alone, or 0.
    """
    both = dense.select("paper_id", "score", F.col("rank").alias("d")).join(lexical.select("paper_id", F.col("rank").alias("l")), "paper_id", "full")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    joined = both.join(best.select("paper_id", "best"), "paper_id", "left").withColumn("rrf", part("d") + part("l"))
    order = [F.desc(F.round("rrf", 12)), F.asc_nulls_last("d"), F.asc("l")]
    ranked = joined.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return ranked.select("paper_id", F.coalesce("score", "best", F.lit(0.0)).alias("score"), "rrf", "rank")


def blend_signals(pool: DataFrame, papers: DataFrame, signals: DataFrame, as_of: str, half_life_days: float = 365.0) -> DataFrame:
    """pool with fresh (halving each half-life), coded (1 with code) and cited (log-scaled up to 1000 citations)."""
    known = pool.join(papers.select("paper_id", "published_utc", "code_url"), "paper_id").join(signals.select("paper_id", "citation_count"), "paper_id", "left")
    fresh = F.pow(F.lit(2.0), -dates.age_days(F.col("published_utc"), as_of) / half_life_days)
    cited = F.least(F.lit(1.0), F.log(1.0 + F.coalesce("citation_count", F.lit(0))) / F.log(F.lit(1001.0)))
    return known.select(*pool.columns, fresh.alias("fresh"), F.col("code_url").isNotNull().cast("double").alias("coded"), cited.alias("cited"))


def blended(similarity: Column | float, recency: Column | float, code: Column | float, citations: Column | float) -> Column:
    """The weighted sum of a paper's score and signals; weights are numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return lit(similarity) * F.col("score") + lit(recency) * F.col("fresh") + lit(code) * F.col("coded") + lit(citations) * F.col("cited")


def blend(pool: DataFrame, papers: DataFrame, signals: DataFrame, as_of: str, similarity: float = 1.0, recency: float = 0.0, code: float = 0.0, citations: float = 0.0, half_life_days: float = 365.0) -> DataFrame:
    """pool with blended: cosine, recency halving each half-life, a bonus for code, and log-scaled citations up to 1000."""
    known = blend_signals(pool, papers, signals, as_of, half_life_days)
    return known.select(*pool.columns, blended(similarity, recency, code, citations).alias("blended"))


def ranked_by_blend(blended: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    order = W.partitionBy(*by).orderBy(F.desc(F.round("blended", 9)), F.desc(F.round("score", 9)), "paper_id")
    return blended.withColumn("rank", F.row_number().over(order))


def rerank_head(pool: DataFrame, depth: int, scorer: Column, by: Sequence[str] = ()) -> DataFrame:
    """The first `depth` papers reordered by a scorer, larger first; the tail keeps its order behind them."""
    tail = F.col("rank") > depth
    order = (W.partitionBy(*by) if by else W).orderBy(tail, F.desc(F.when(~tail, scorer)), "rank")
    return pool.withColumn("new_rank", F.row_number().over(order))


def select_slots(pool: DataFrame, limit: int, experience: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    """(by, paper_id, score, rank, is_wildcard): the best papers, and in the last two slots the least like the user's experience.

    pool has ranks from 1, within each group of by. Without experience, with a pool no larger than the limit, or a limit of two or
    less, the best papers alone. Papers without an experience score come last among wildcards, in the pool's order.
    """
    columns, keys = [*by, "paper_id", "score", "rank", "is_wildcard"], [*by, "paper_id"]
    plain = pool.where(F.col("rank") <= limit).withColumn("is_wildcard", F.lit(False))
    if experience is None or limit <= WILDCARD_SLOTS:
        return plain.select(*columns)
    head = limit - WILDCARD_SLOTS
    known = pool.join(experience.select(*keys, F.col("score").alias("e")), keys, "left").withColumn("size", F.count("*").over(W.partitionBy(*by)))
    order = W.partitionBy(*by, F.col("rank") <= head).orderBy(F.asc_nulls_last(F.round("e", 9)), "rank")
    placed = known.withColumn("w", F.row_number().over(order))
    kept = placed.where(F.when(F.col("size") <= limit, F.col("rank") <= limit).otherwise((F.col("rank") <= head) | (F.col("w") <= WILDCARD_SLOTS)))
    wild = (F.col("size") > limit) & (F.col("rank") > head)
    placed = F.when(wild, head + F.col("w")).otherwise(F.col("rank")).cast("int").alias("rank")
    return kept.select(*by, "paper_id", "score", placed, wild.alias("is_wildcard"))


def fuse_many(dense: DataFrame, lexical: DataFrame, top: int) -> DataFrame:
    """fuse of each search: (query_id, paper_id, score, rrf, rank) from dense (query_id, paper_id, score, rank) and lexical
    (query_id, paper_id, rank); score is null for papers found by words alone."""
    keys = ["query_id", "paper_id"]
    both = dense.select(*keys, "score", F.col("rank").alias("d")).join(lexical.select(*keys, F.col("rank").alias("l")), keys, "full")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), F.asc_nulls_last("d"), F.asc("l"))
    ranked = both.withColumn("rrf", part("d") + part("l")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select(*keys, "score", "rrf", "rank")


def proximity(score: Column) -> Column:
    """close, stretch or null."""
    return F.when(score >= CLOSE, "close").when(score < STRETCH, "stretch")


def relevance_tier(rank: Column, count: Column) -> Column:
    place = (rank - 1) / count
    return F.when(place < 0.25, "high").when(place < 0.6, "good").otherwise("fair")


def interleaved(control: list[int], candidate: list[int], limit: int, coin: Callable[[int], bool]) -> list[tuple[int, str]]:
    """Team draft of two rankings: in each round a coin says who picks first; each side picks its best paper not taken yet."""
    sides = {"A": iter(control), "B": iter(candidate)}
    taken: set[int] = set()
    out: list[tuple[int, str]] = []
    live, turn = {"A", "B"}, 0
    while live and len(out) < limit:
        for side in ("A", "B") if coin(turn) else ("B", "A"):
            if len(out) < limit and side in live:
                pick = next((p for p in sides[side] if p not in taken), None)
                if pick is None:
                    live.discard(side)
                else:
                    taken.add(pick)
                    out.append((pick, side))
        turn += 1
    return out


def coin(search: int, turn: int, seed: int) -> bool:
    """Whether the control picks first: the first digit of a checksum, so that each side begins half of the rounds."""
    return hashlib.md5(f"{search}:{turn}:{seed}".encode()).hexdigest() < "8"


def team_draft(ranked: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """(search_id, rank, paper_id, variant) from ranked (search_id, variant A or B, rank, paper_id).

    A search's two lists are no longer than the pool, so each is drafted by itself. A coin of search, round and seed says
    who picks first. A paper that a list repeats is drafted once.
    """

    def draft(frames: pd.DataFrame) -> pd.DataFrame:
        rows = frames.sort_values(["variant", "rank"])
        search = int(rows["search_id"].iloc[0])
        lists = [rows.loc[rows["variant"] == v, "paper_id"].tolist() for v in "AB"]
        found = interleaved(*lists, limit, lambda turn: coin(search, turn, seed))
        return pd.DataFrame({"search_id": [search] * len(found), "rank": range(1, len(found) + 1), "paper_id": [p for p, _ in found], "variant": [v for _, v in found]})

    return ranked.where(F.col("rank") <= limit).groupBy("search_id").applyInPandas(draft, "search_id long, rank int, paper_id long, variant string")


def ranks(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """rows with rank, from 1 within each group, and size, the group's rows; order has to decide between any two rows.

    Rows are dealt by range of group and order and stored, so that a group of a third of all rows spreads over tasks. A row's
    rank is its place among its group's rows in its part, after those of earlier parts: a row for each part and group.
    """
    keys = [F.asc(c) for c in by] + [F.asc(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_id", 33))
    group = F.struct(*by) if by else F.struct(F.lit(0))
    here = placed.withColumn("_group", group).groupBy("_group", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_here"))
    earlier = F.sum("_here").over(W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counted = here.select("_group", "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_here").over(W.partitionBy("_group")).alias("size"))
    joined = placed.withColumn("_group", group).join(counted, ["_group", "_part"])
    return joined.select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("int").alias("rank"), "size")
