"""Changing tables without MERGE: each function returns the rows that the table, or the change, consists of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import dates, vectors
from lectern.operators.ranking import ranks


def first_of_page(page: DataFrame, key: str, *position: str) -> DataFrame:
    """One row of each key: the first by its position in the page; without a position, the smallest by its other columns."""
    order = [F.asc(c) for c in (position or [c for c in page.columns if c != key])]
    return page.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert_diff(table: DataFrame, page: DataFrame, key: str, compared: Sequence[str], position: Sequence[str] = ()) -> DataFrame:
    """(key, change) for each key of page: added, updated if any compared column differs, else same. Nulls are equal.

    Of a key's several rows in the page the first counts.
    """
    old = table.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in compared), F.lit(True).alias("_old"))
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = first_of_page(page, key, *position).join(old, key, "left")
    return joined.select(key, F.when(F.col("_old").isNull(), "added").when(differs, "updated").otherwise("same").alias("change"))


def upsert(table: DataFrame, page: DataFrame, key: str, kept: Sequence[str] = (), position: Sequence[str] = ()) -> DataFrame:
    """The table after the page: the page's rows, the first of each key, replace those with their key, but for columns kept from the old row."""
    once = first_of_page(page, key, *position)
    old = table.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in kept))
    fresh = once.join(old, key, "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in kept else F.col(c) for c in table.columns))
    return table.join(page.select(key), key, "left_anti").select(*table.columns).unionByName(fresh)


def add_only(table: DataFrame, page: DataFrame, key: str, position: Sequence[str] = ()) -> DataFrame:
    """The page's rows whose key the table lacks, the first of each; existing rows stay untouched."""
    return first_of_page(page, key, *position).join(table.select(key), key, "left_anti")


def updated_counts(changes: DataFrame) -> DataFrame:
    """One row: fetched, added and updated keys of upsert_diff."""
    return changes.agg(F.count("*").alias("fetched"), F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "updated").alias("updated"))


def with_embeddings(stored: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """(paper_id, model_version, vector, q, scale): stored vectors after an embedding run, one row for each paper.

    fresh (paper_id, vector) are the run's; they replace a paper's vector of any model. Stored rows without q are quantised.
    """
    new = fresh.select("paper_id", F.lit(model).alias("model_version"), "vector")
    every = stored.join(new.select("paper_id"), "paper_id", "left_anti").unionByName(new, allowMissingColumns=True)
    q = F.coalesce("q", vectors.int8_values(F.col("vector")))
    return every.select("paper_id", "model_version", "vector", q.alias("q"), F.coalesce("scale", vectors.int8_scale(F.col("vector"))).alias("scale"))


def with_accounts(users: DataFrame, grants: DataFrame, logins: DataFrame, first_grant: int, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(users, grants) after logins (external_id, email): who has no account gets an inactive one, with a first grant.

    Ids follow the largest one, in the order of external ids. A second login of one person in the page, or one that has an
    account, changes nothing.
    """
    new = first_of_page(logins, "external_id").join(users.select("external_id"), "external_id", "left_anti")
    last = users.agg(F.coalesce(F.max("user_id"), F.lit(0).cast("long")).alias("last"))
    numbered = ranks(new, [], ["external_id"]).join(F.broadcast(last)).select((F.col("last") + F.col("rank")).alias("user_id"), "external_id", "email", F.lit(False).alias("is_active"))
    granted = numbered.select("user_id", F.lit(first_grant).cast("long").alias("amount_micros"), F.lit("welcome").alias("reason"), dates.moment(as_of).alias("created_utc"))
    return users.select("user_id", "external_id", "email", "is_active").unionByName(numbered), grants.select("user_id", "amount_micros", "reason", "created_utc").unionByName(granted)


def with_roles(users: DataFrame, changes: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(users, audit) after role changes (user_id, role), the first of each user: promotion activates, and each change is
    logged with the value before it; a role that a user has already changes nothing."""
    wanted = first_of_page(changes, "user_id").select("user_id", F.col("role").alias("_role"))
    joined = users.join(wanted, "user_id", "left").withColumn("_new", F.col("_role").isNotNull() & ~F.col("_role").eqNullSafe(F.col("role")))
    audit = joined.where("_new").select("user_id", F.lit("role").alias("action"), F.col("role").alias("before"), F.col("_role").alias("after"), dates.moment(as_of).alias("created_utc"))
    active = F.col("is_active") | (F.col("_new") & F.col("_role").isin("Member", "Admin", "Owner"))
    after = joined.select(*(F.when(F.col("_new"), F.col("_role")).otherwise(F.col(c)).alias(c) if c == "role" else active.alias(c) if c == "is_active" else F.col(c) for c in users.columns))
    return after, audit


def ensured(table: DataFrame, wanted: DataFrame, key: str, columns: dict) -> DataFrame:
    """Rows to add so that every wanted key has one. columns: other columns of a new row."""
    return wanted.select(key).distinct().join(table.select(key), key, "left_anti").select(key, *(v.alias(k) for k, v in columns.items()))


def reconciled(links: DataFrame, wanted: DataFrame, owner: str, other: str) -> DataFrame:
    """(owner, other, change) for owners in wanted: links to remove and to add; owners that wanted lacks keep theirs."""
    touched = links.join(wanted.select(owner).distinct(), owner, "left_semi")
    gone = touched.join(wanted, [owner, other], "left_anti").select(owner, other, F.lit("removed").alias("change"))
    new = wanted.join(touched, [owner, other], "left_anti").select(owner, other, F.lit("added").alias("change"))
    return gone.unionByName(new.distinct())


def newest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last in an order of columns."""
    place = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def claimed(rows: DataFrame, user_id: int) -> DataFrame:
    """Rows without an owner become the user's."""
    return rows.withColumn("user_id", F.coalesce("user_id", F.lit(user_id).cast("long")))


def saved_profile(profiles: DataFrame, page: DataFrame) -> DataFrame:
    """Profiles after a save: the version goes up by one, which makes the user's analyses stale."""
    old = profiles.select("user_id", F.col("version").alias("_v"))
    fresh = page.join(old, "user_id", "left").withColumn("version", F.coalesce(F.col("_v"), F.lit(0)) + 1).drop("_v")
    return profiles.join(page.select("user_id"), "user_id", "left_anti").select(*profiles.columns).unionByName(fresh.select(*profiles.columns))


def high_water_marks(papers: DataFrame, paper_categories: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(category, high_water_mark_utc): the newest paper of each category; an old mark never goes back."""
    new = paper_categories.join(papers.select("paper_id", "published_utc"), "paper_id").groupBy("category").agg(F.max("published_utc").alias("high_water_mark_utc"))
    if marks is None:
        return new
    both = new.join(marks.select("category", F.col("high_water_mark_utc").alias("_old")), "category", "full")
    return both.select("category", F.greatest("high_water_mark_utc", "_old").alias("high_water_mark_utc"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Counters, joined errors (at most 2000 characters) and status of the parts of ingestion runs, by run: Failed if every part failed."""
    errors = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("part", "error")))), lambda x: x["error"]), " | "), 1, 2000)
    status = F.when(F.count("error") == F.count("*"), "Failed").otherwise("Completed")
    return runs.groupBy("run_id").agg(F.sum("fetched").alias("fetched"), F.sum("added").alias("added"), F.sum("updated").alias("updated"), errors.alias("error"), status.alias("status"))
