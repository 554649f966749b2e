"""Revisions: how a delivered version stands to the stored one, and what that makes of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_verdict(stored: Column, new: Column) -> Column:
    """``equal``, ``newer``, ``older`` or ``mixed`` of two component maps with the same keys; null for other keys."""
    keys = F.array_sort(F.map_keys(stored)) == F.array_sort(F.map_keys(new))
    step = F.map_values(F.map_zip_with(new, stored, lambda _, a, b: a - b))
    all_ = lambda test: F.forall(step, test)
    return F.when(~keys, None).when(all_(lambda d: d == 0), "equal").when(all_(lambda d: d >= 0), "newer").when(all_(lambda d: d <= 0), "older").otherwise("mixed")


def revision_outcome(stored_hash: Column, new_hash: Column, stored: Column, new: Column) -> Column:
    """Outcome of a delivered revision (map of component to long) against the stored one; a null hash means no stored row.

    insert, noop, newer, revision_only, stale_skip, unordered_noop or revision_conflict.
    """
    by_hash = lambda yes, no: F.when(stored_hash == new_hash, yes).otherwise(no)
    order = order_verdict(stored, new)
    ordered = F.when(order == "equal", by_hash("noop", "revision_conflict")).when(order == "newer", by_hash("revision_only", "newer")).when(order == "older", "stale_skip")
    unordered = by_hash("unordered_noop", "revision_conflict")
    return (
        F.when(stored_hash.isNull(), "insert").when(stored.isNull() & new.isNull(), by_hash("noop", "revision_conflict"))
        .when(stored.isNotNull() & new.isNotNull(), F.coalesce(ordered, unordered)).otherwise(unordered)
    )


def merge_batch(stored: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """key, hash, revision, content, outcome: the next state of the store.

    Both sides have key, hash, revision (map) and content. insert and newer take the candidate whole,
    revision_only takes its revision, every other outcome leaves the stored row; rows without a candidate
    are ``keep``. One candidate a key; rank versions before.
    """
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("hash", "revision", "content")])
    both = side(stored.withColumn("hash", F.col("hash")), "s").join(side(candidates, "c"), key, "full")
    outcome = F.when(F.col("c_hash").isNull(), "keep").otherwise(revision_outcome(F.col("s_hash"), F.col("c_hash"), F.col("s_revision"), F.col("c_revision")))
    both = both.withColumn("outcome", outcome)
    whole, dated = F.col("outcome").isin("insert", "newer"), F.col("outcome").isin("insert", "newer", "revision_only")
    pick = lambda test, c: F.when(test, F.col(f"c_{c}")).otherwise(F.col(f"s_{c}")).alias(c)
    return both.select(key, pick(whole, "hash"), pick(dated, "revision"), pick(whole, "content"), "outcome")
