"""JSON columns: search plans, single fields, open details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.schemas import ANALYSIS, PLAN


def plan_of(text: Column) -> Column:
    """A stored plan as a struct; null if the text is no JSON object."""
    return F.from_json(text, PLAN)


def plan_json(plan: Column) -> Column:
    return F.to_json(plan)


def field_or_blank(text: Column, path: str) -> Column:
    """One field of a JSON text; blank if the text is malformed or lacks it."""
    return F.coalesce(F.get_json_object(text, path), F.lit(""))


def details(text: Column) -> Column:
    """Open details as a variant; an empty object for null or malformed text."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}")))


def checked_plan(plan: Column, known: Column) -> Column:
    """A compiled plan made safe: categories that are known (in their stored spelling), a window above zero, a blank
    hypothetical abstract and an intent outside the list as null. A blank anchor makes the whole plan null."""
    lowered = F.transform(F.coalesce(plan["categories"], F.array().cast("array<string>")), lambda c: F.lower(c))
    categories = F.filter(known, lambda k: F.array_contains(lowered, F.lower(k)))
    intent = F.lower(F.trim(plan["intent"]))
    safe = F.struct(
        plan["interpretation"].alias("interpretation"),
        plan["anchorText"].alias("anchorText"),
        categories.alias("categories"),
        F.when(plan["dateWindowDays"] > 0, plan["dateWindowDays"]).alias("dateWindowDays"),
        F.coalesce(plan["requireNoCode"], F.lit(False)).alias("requireNoCode"),
        F.when(F.trim(plan["hypotheticalAbstract"]) != "", plan["hypotheticalAbstract"]).alias("hypotheticalAbstract"),
        F.when(intent.isin("precise", "exploratory", "mixed"), intent).alias("intent"),
    )
    return F.when(F.coalesce(F.trim(plan["anchorText"]), F.lit("")) != "", safe)


def analysis_of(text: Column) -> Column:
    """A model's analysis as a struct; null if the text is no JSON object, or lacks one of the contract's fields."""
    fields = F.json_object_keys(text)
    whole = F.size(F.array_except(F.array(*(F.lit(f.name) for f in ANALYSIS)), fields)) == 0
    return F.when(whole, F.from_json(text, ANALYSIS))
