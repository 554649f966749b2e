"""Scores of predicted documents against gold ones, field by field."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(predicted: DataFrame, gold: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, ``{field}_ok``, exact, first_wrong for every gold item: null-safe equality; an item without a prediction is wrong in ``missing``."""
    p = predicted.select(key, F.lit(True).alias("_p"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    both = gold.select(key, *fields).join(p, key, "left")
    there = F.col("_p").isNotNull()
    ok = {f: there & F.col(f).eqNullSafe(F.col(f"_p_{f}")) for f in fields}
    wrong = F.when(~there, "missing")
    for f in fields:
        wrong = wrong.when(~ok[f], f)
    return both.select(key, *[c.alias(f"{f}_ok") for f, c in ok.items()], functools.reduce(Column.__and__, ok.values()).alias("exact"), wrong.alias("first_wrong"))


def rates(items: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """by, n, exact and a rate for each field, of scored items."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return items.groupBy(*by).agg(F.count("*").alias("n"), rate("exact").alias("exact"), *[rate(f"{f}_ok").alias(f) for f in fields])


def score_outcomes(items: DataFrame, outcomes: DataFrame, fields: list[str]) -> DataFrame:
    """id, category, gold_kind, predicted_kind, kind_match, clarification_appropriate, missing_match, ``{field}_ok``, exact, failure, tokens.

    ``items``: id, category, kind (plan, clarify, unsupported), ambiguous, missing (array), and the fields of the gold plan; ``outcomes``:
    id, kind, missing, invalid (the plan was refused before it was asked about), the fields of the plan, tokens. An item without an outcome is a ``provider_error``.
    Fields and ``exact`` are null but for gold plans, ``missing_match`` but for gold clarifications. Failures: provider_error,
    missing_clarification, unnecessary_clarification, invalid_plan, unsupported_mismatch, wrong_{first field that differs}.
    """
    p = outcomes.select("id", F.lit(True).alias("_p"), F.col("kind").alias("_kind"), F.col("missing").alias("_missing"), F.col("invalid").alias("_invalid"), "tokens", *[F.col(f).alias(f"_p_{f}") for f in fields])
    both = items.select("id", "category", "kind", "ambiguous", "missing", *fields).join(p, "id", "left")
    there, kind, asked = F.col("_p").isNotNull(), F.col("kind"), F.coalesce(F.col("_kind") == "clarify", F.lit(False))
    plan, planned, same = kind == "plan", F.coalesce(F.col("_kind") == "plan", F.lit(False)), F.coalesce(kind == F.col("_kind"), F.lit(False))
    ok = {f: F.when(plan, planned & F.col(f).eqNullSafe(F.col(f"_p_{f}"))) for f in fields}
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    refused = F.when(asked, "unnecessary_clarification").otherwise("unsupported_mismatch")
    wrong = F.when(~there, "provider_error").when((kind == "clarify") & ~asked, "missing_clarification").when((kind == "unsupported") & ~same, refused)
    wrong = wrong.when(plan & ~planned & asked & F.coalesce("_invalid", F.lit(False)), "invalid_plan").when(plan & ~planned, refused)
    for f in fields:
        wrong = wrong.when(plan & ~ok[f], f"wrong_{f}")
    return both.select(
        "id", "category", kind.alias("gold_kind"), F.when(there, F.col("_kind")).otherwise("error").alias("predicted_kind"), same.alias("kind_match"),
        F.when(there, asked == F.col("ambiguous")).otherwise(~F.col("ambiguous")).alias("clarification_appropriate"),
        F.when(there & (kind == "clarify"), asked & (as_set("missing") == as_set("_missing"))).alias("missing_match"),
        *[c.alias(f"{f}_ok") for f, c in ok.items()], functools.reduce(Column.__and__, ok.values()).alias("exact"), wrong.alias("failure"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )


def summary(scored: DataFrame, fields: list[str]) -> DataFrame:
    """category (null: all items), items, plan_items, kind_accuracy, plan_exact_match, clarification_appropriateness, a rate for each field, tokens_per_query."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return scored.groupingSets([[F.col("category")], []], F.col("category")).agg(
        (F.grouping_id() > 0).alias("overall"), F.count("*").alias("items"), F.count_if(F.col("gold_kind") == "plan").alias("plan_items"), rate("kind_match").alias("kind_accuracy"), rate("exact").alias("plan_exact_match"),
        rate("clarification_appropriate").alias("clarification_appropriateness"), *[rate(f"{f}_ok").alias(f) for f in fields], F.avg("tokens").alias("tokens_per_query"),
    )


def failure_counts(scored: DataFrame) -> DataFrame:
    """failure, n of the items that failed."""
    return scored.where("failure IS NOT NULL").groupBy("failure").agg(F.count("*").alias("n"))
