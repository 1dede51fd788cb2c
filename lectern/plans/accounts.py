"""Budgets as sums over an append-only ledger, call gates, costs, and the list of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dates
from lectern.operators import filters

DAILY_CALLS = 200


def balances(users: DataFrame, grants: DataFrame, usage: DataFrame) -> DataFrame:
    """(user_id, granted, spent, remaining) in micros for every user; calls with the user's own key cost nothing."""
    given = grants.groupBy("user_id").agg(F.sum("amount_micros").alias("granted"))
    used = usage.where("not used_byo_key").groupBy("user_id").agg(F.sum("cost_micros").alias("spent"))
    zero = F.lit(0).cast("long")
    joined = users.join(given, "user_id", "left").join(used, "user_id", "left").select(*users.columns, F.coalesce("granted", zero).alias("granted"), F.coalesce("spent", zero).alias("spent"))
    return joined.withColumn("remaining", F.greatest(zero, F.col("granted") - F.col("spent")))


def daily_calls(usage: DataFrame, as_of: str) -> DataFrame:
    """(user_id, calls) since midnight, without calls with an own key."""
    today = usage.where(~F.col("used_byo_key") & (F.col("created_utc") >= dates.day_of(dates.moment(as_of))))
    return today.groupBy("user_id").agg(F.count("*").alias("calls"))


def gate(balance: DataFrame, calls: DataFrame, cap: int = DAILY_CALLS) -> DataFrame:
    """balance with calls and verdict: daily_cap, no_budget or allowed; the cap is tested first."""
    joined = balance.join(calls, "user_id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    return joined.withColumn("verdict", F.when(F.col("calls") >= cap, "daily_cap").when(F.col("remaining") <= 0, "no_budget").otherwise("allowed"))


def calls_per_day(usage: DataFrame) -> DataFrame:
    """(user_id, day, calls, capped) for calls without an own key."""
    rows = usage.where("not used_byo_key").groupBy("user_id", dates.day_of(F.col("created_utc")).alias("day")).agg(F.count("*").alias("calls"))
    return rows.withColumn("capped", F.col("calls") >= DAILY_CALLS)


def cost_micros(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Micro-dollars of a call, rounded up; 0 for a model without prices. Prices are dollars for a million tokens."""
    exact = tokens_in * price_in.cast("decimal(12,6)") + tokens_out * price_out.cast("decimal(12,6)")
    return F.coalesce(F.ceil(exact).cast("long"), F.lit(0).cast("long"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens) with cost_micros from prices (model, price_in, price_out)."""
    joined = usage.join(prices, "model", "left")
    return joined.select(*usage.columns, cost_micros(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out")).alias("cost_micros"))


def action_estimate(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, papers: Column) -> Column:
    """Dollars that an action on some papers is likely to cost; prices are dollars for a million tokens."""
    return (tokens_in * price_in.cast("double") + tokens_out * price_out.cast("double")) / F.lit(1e6) * papers


def composite_score(raw: Column) -> Column:
    """A model's score held to 0..100, with two decimals, halves to even; null stays null."""
    return F.when(raw.isNotNull(), F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw.cast("double"))), 2))


def step_models(steps: DataFrame, overrides: DataFrame, registry: DataFrame, default: str) -> DataFrame:
    """(step, model): the override if the registry knows it, else the default."""
    known = overrides.join(registry.select("model"), "model", "left_semi").select("step", "model")
    return steps.join(known, "step", "left").select("step", F.coalesce("model", F.lit(default)).alias("model"))


def user_list(users: DataFrame, term: str | None = None) -> DataFrame:
    """Users whose e-mail or name holds the term, by name and id; all users without a term."""
    found = users.where(filters.holds_either(term, "email", "display_name")) if term else users
    return found.orderBy("display_name", "user_id")
