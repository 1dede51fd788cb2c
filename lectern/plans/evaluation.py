"""Offline evaluation, all queries at once: ranking metrics, agreement, category inference, audits, samples, tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RELEVANT = 2


def first_grades(judgments: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One grade for each query and paper: the first in the given order (the smallest source, if there is one, and grade by default)."""
    default = [F.asc(c) for c in ("source", "grade") if c in judgments.columns]
    place = W.partitionBy("query_id", "paper_id").orderBy(*(order or default))
    return judgments.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def graded(ranked: DataFrame, judgments: DataFrame) -> DataFrame:
    """ranked (query_id, paper_id, rank) with grade, 0 for papers that nobody judged, and judged."""
    known = judgments.select("query_id", "paper_id", F.col("grade").alias("_g"))
    joined = ranked.join(known, ["query_id", "paper_id"], "left")
    return joined.select("query_id", "paper_id", "rank", F.coalesce("_g", F.lit(0)).alias("grade"), F.col("_g").isNotNull().alias("judged"))


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def without_wildcards(ranked: DataFrame) -> DataFrame:
    """ranked (with is_wildcard) without its wildcards; the papers behind them move up."""
    kept = ranked.where(~F.coalesce("is_wildcard", F.lit(False)))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def metrics(ranked: DataFrame, judgments: DataFrame, k: int = 10, depth: int = 50, order: list[Column] | None = None) -> DataFrame:
    """(query_id, ndcg, recall, reciprocal_rank, judged_at_k, judged, relevant) for each query with a judgment.

    All three metrics are null for a query without the grades that they need, so that means skip it. Of several judgments
    of a paper the first in order counts, wildcards (is_wildcard, if ranked has it) don't, and a paper that a ranking repeats
    counts where it comes first.
    """
    judgments = first_grades(judgments, order)
    ranked = without_wildcards(ranked) if "is_wildcard" in ranked.columns else ranked
    rows = graded(ranked.groupBy("query_id", "paper_id").agg(F.min("rank").alias("rank")), judgments)
    discount = F.log2(F.col("rank") + 1.0)
    shown = rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade")) / discount)).alias("dcg"),
        F.count_if((F.col("rank") <= depth) & (F.col("grade") >= RELEVANT)).alias("found"),
        F.min(F.when(F.col("grade") >= RELEVANT, F.col("rank"))).alias("first"),
        F.count_if((F.col("rank") <= k) & F.col("judged")).alias("judged_at_k"),
    )
    counts = judgments.groupBy("query_id", "grade").agg(F.count("*").alias("n"))  # a few grades for each query, however many judgments
    before = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = F.when(F.col("before") < k, F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k))))
    discounts = F.aggregate(F.coalesce(places, F.array().cast("array<long>")), F.lit(0.0), lambda s, x: s + 1.0 / F.log2(x + 1.0))
    best = counts.withColumn("before", before).groupBy("query_id").agg(
        F.sum(F.when(F.col("grade") > 0, _gain(F.col("grade")) * discounts)).alias("ideal"),
        F.sum("n").alias("judged"),
        F.sum(F.when(F.col("grade") >= RELEVANT, F.col("n")).otherwise(0)).alias("relevant"),
    )
    joined = best.join(shown, "query_id", "left")
    some = F.col("relevant") > 0
    return joined.select(
        "query_id",
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
        F.when(some, F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"),
        F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.coalesce("judged_at_k", F.lit(0)).alias("judged_at_k"),
        "judged",
        "relevant",
    )


def means(per_query: DataFrame) -> DataFrame:
    """Means that skip undefined values."""
    return per_query.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("ndcg", "recall", "reciprocal_rank")), F.count("*").alias("queries"))


def passes(per_query: DataFrame, least_ndcg: float) -> DataFrame:
    """The gate of a build: whether the mean nDCG is at least least_ndcg."""
    return means(per_query).select("mean_ndcg", (F.coalesce("mean_ndcg", F.lit(0.0)) >= least_ndcg).alias("passed"))


def confusion(pairs: DataFrame, grades: int = 4) -> DataFrame:
    """(orig, cal, n) for every pair of grades, zero included."""
    grid = pairs.sparkSession.range(grades * grades).select((F.col("id") / grades).cast("int").alias("orig"), (F.col("id") % grades).cast("int").alias("cal"))
    counts = pairs.groupBy("orig", "cal").agg(F.count("*").alias("n"))
    return grid.join(counts, ["orig", "cal"], "left").select("orig", "cal", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_pivot(pairs: DataFrame) -> DataFrame:
    """A row for each original grade, a column for each calibrated one."""
    return pairs.groupBy("orig").pivot("cal", [0, 1, 2, 3]).count().select("orig", *(F.coalesce(f"`{g}`", F.lit(0)).alias(f"cal_{g}") for g in range(4)))


def weighted_kappa(pairs: DataFrame, grades: int = 4) -> DataFrame:
    """Quadratic weighted kappa: 0 for no pairs, 1 if chance alone would agree in full."""
    cells = confusion(pairs, grades)
    rows = cells.withColumn("r", F.sum("n").over(W.partitionBy("orig"))).withColumn("c", F.sum("n").over(W.partitionBy("cal")))
    weight = F.pow(F.col("orig") - F.col("cal"), 2) / float((grades - 1) ** 2)
    sums = rows.agg(F.sum(weight * F.col("n")).alias("seen"), F.sum(weight * F.col("r") * F.col("c")).alias("chance"), F.sum("n").alias("n"))
    kappa = F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("chance") == 0, F.lit(1.0)).otherwise(1.0 - F.col("seen") * F.col("n") / F.col("chance"))
    return sums.select(F.col("n").cast("long").alias("n"), kappa.alias("kappa"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Shares of pairs with the same grade, and with grades at most one apart; the judges (an optional column), sorted."""
    apart = F.abs(F.col("orig") - F.col("cal"))
    judges = [F.array_join(F.array_sort(F.collect_set("judge")), ", ").alias("judges")] if "judge" in pairs.columns else []
    return pairs.agg(F.count("*").alias("n"), F.avg((apart == 0).cast("double")).alias("exact"), F.avg((apart <= 1).cast("double")).alias("within_one"), *judges)


def disagreements(pairs: DataFrame, top: int = 8) -> DataFrame:
    """The pairs that differ most, by two at least."""
    apart = F.abs(F.col("orig") - F.col("cal"))
    return pairs.where(apart >= 2).withColumn("apart", apart).orderBy(F.desc("apart"), "paper_id").limit(top)


def category_scores(runs: DataFrame) -> DataFrame:
    """runs (emitted, expected, acceptable arrays) with precision, recall, reachable_recall and f1; case does not count.

    Emitted categories that are acceptable aren't held against precision. Recall counts expected ones; the reachable part
    leaves out what known (an optional array) lacks. Without emitted precision is 1, without expected recall is 1.
    """
    low = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x)))
    rows = runs.withColumn("_em", low("emitted")).withColumn("_ex", low("expected")).withColumn("_ok", F.array_union(low("expected"), low("acceptable")))
    rows = rows.withColumn("_re", F.array_intersect("_ex", low("known")) if "known" in runs.columns else F.col("_ex"))
    share = lambda a, b: F.when(F.size(b) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))
    precision = F.when(F.size("_em") == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("_em", "_ok")) / F.size("_em"))
    rows = rows.withColumn("precision", precision).withColumn("recall", share(F.col("_em"), F.col("_ex"))).withColumn("reachable_recall", share(F.col("_em"), F.col("_re")))
    both = F.col("precision") + F.col("reachable_recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("reachable_recall") / both).otherwise(F.lit(0.0))).drop("_em", "_ex", "_ok", "_re")


def category_means(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """Over a query's runs: mean precision, recall, reachable recall and f1, and the smallest and largest f1."""
    return scored.groupBy(by).agg(*(F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "reachable_recall", "f1")), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"), F.count("*").alias("runs"))


def category_report(scored: DataFrame, by: str = "query_id", run: str = "run") -> DataFrame:
    """(run, mean_f1, mean_precision, mean_recall) for each run over its queries, and as run null the macro row: the means
    over queries of each query's mean over runs."""
    names = ("precision", "recall", "f1")
    each = scored.groupBy(run).agg(*(F.avg(c).alias(f"mean_{c}") for c in names))
    queries = scored.groupBy(by).agg(*(F.avg(c).alias(c) for c in names))
    macro = queries.agg(*(F.avg(c).alias(f"mean_{c}") for c in names))
    return each.unionByName(macro.withColumn(run, F.lit(None).cast(dict(scored.dtypes)[run])))


def category_occurrences(runs: DataFrame, by: str = "query_id") -> DataFrame:
    """How many of a query's runs emitted each category, most frequent first."""
    rows = runs.select(by, F.explode(F.array_distinct("emitted")).alias("category")).groupBy(by, "category").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "category")))


def missed_gems(judgments: DataFrame, candidates: DataFrame, pool: int = 50) -> DataFrame:
    """(query_id, sampled, relevant, candidates, surfaced, estimate) for each judged query of candidates (query_id, candidates).

    estimate: papers outside the pool that the random sample says are relevant; null without a sample. surfaced: relevant
    papers of the pool.
    """
    random, good = F.col("source") == "random", F.col("grade") >= RELEVANT
    drawn = judgments.groupBy("query_id").agg(F.count_if(random).alias("sampled"), F.count_if(random & good).alias("relevant"), F.count_if((F.col("source") == "pool") & good).alias("surfaced"))
    rate = F.col("relevant") / F.expr("nullif(sampled, 0)")
    estimate = rate * F.greatest(F.lit(0), F.col("candidates") - pool)
    return candidates.join(drawn, "query_id").select("query_id", "sampled", "relevant", "candidates", "surfaced", estimate.alias("estimate"))


def stratified(judgments: DataFrame, total: int, grades: int = 4) -> DataFrame:
    """ceil(total / grades) judgments of each grade, in the order of a checksum of query and paper.

    Each task keeps its best of a grade before the grades are gathered, so a grade with a third of all rows is no hot group.
    """
    each = -(-total // grades)
    return _first_by(judgments, ["grade"], each)


def random_sample(candidates: DataFrame, pooled: DataFrame, n: int) -> DataFrame:
    """n candidates of each query that aren't pooled, in the order of a checksum of query and paper."""
    return _first_by(candidates.join(pooled.select("query_id", "paper_id"), ["query_id", "paper_id"], "left_anti"), ["query_id"], n)


def _first_by(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    keyed = rows.withColumn("key", F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("paper_id").cast("string"))))
    salted = keyed.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(64)))
    order = [F.asc("key"), F.asc("paper_id")]
    part = salted.withColumn("_n", F.row_number().over(W.partitionBy(*by, "_s").orderBy(*order))).where(F.col("_n") <= n)
    return part.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_s", "_n")


def availability(judged: DataFrame, papers: DataFrame) -> DataFrame:
    """How many judged papers the corpus has, and how many it lacks."""
    here = papers.select("paper_id", F.lit(True).alias("_here"))
    ids = judged.select("paper_id").distinct().join(here, "paper_id", "left")
    return ids.agg(F.count_if(F.col("_here").isNotNull()).alias("present"), F.count_if(F.col("_here").isNull()).alias("missing"))


def verdicts(raw: DataFrame, asked: DataFrame) -> DataFrame:
    """(batch_id, id, grade) from a judge's answers (batch_id, answer): unknown ids go, grades are held to 0..3, the first of an id counts."""
    from lectern.schemas import VERDICTS

    rows = raw.select("batch_id", F.posexplode(F.from_json("answer", VERDICTS)).alias("position", "v")).select("batch_id", "position", F.col("v.id").alias("id"), F.least(F.lit(3), F.greatest(F.lit(0), F.col("v.grade"))).alias("grade"))
    known = rows.join(asked.select("batch_id", "id"), ["batch_id", "id"], "left_semi")
    return known.withColumn("n", F.row_number().over(W.partitionBy("batch_id", "id").orderBy("position"))).where("n = 1").select("batch_id", "id", "grade")


def batches(rows: DataFrame, order: list[Column], size: int = 10) -> DataFrame:
    """rows with the number of their batch of `size`, in an order within each query."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("query_id").orderBy(*order)) - 1) / size).cast("int"))
