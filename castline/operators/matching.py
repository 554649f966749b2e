"""Joins that ingestion and reporting need: receipts, intervals, rectangles, identities, pointers, content checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.sources.readers import manifest_members


def semi_manifest(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows whose (profile_id, profile_hash) a manifest lists."""
    return rows.join(manifest_members(manifest), ["profile_id", "profile_hash"], "left_semi")


def interval_overlap(receipts: DataFrame, requests: DataFrame, slot: str = "slot") -> DataFrame:
    """Receipts that overlap the request of their slot (half-open), clipped to it as clip_start, clip_end.

    ``receipts`` has start and end, ``requests`` req_start and req_end.
    """
    both = receipts.join(requests, slot)
    meets = (F.col("end") > F.col("req_start")) & (F.col("start") < F.col("req_end"))
    return both.where(meets).withColumns({"clip_start": F.greatest("start", "req_start"), "clip_end": F.least("end", "req_end")})


def rectangle_cells(df: DataFrame) -> DataFrame:
    """``df`` with cell_x, cell_y: a row for each integral-degree cell of its rectangle west, south, width, height (whole degrees)."""
    steps = lambda at, size: F.explode(F.sequence(F.col(at), F.col(at) + F.col(size) - 1))
    held = df.where("width > 0 AND height > 0")
    return held.select("*", steps("west", "width").alias("cell_x")).select("*", steps("south", "height").alias("cell_y"))


def tile_overlap(receipts: DataFrame, cells: DataFrame) -> DataFrame:
    """Receipt rectangles joined to the cells (cell_x, cell_y) they cover."""
    return rectangle_cells(receipts).join(cells, ["cell_x", "cell_y"])


def interval_gaps(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap: whether the union of [start, end) leaves part of [req_start, req_end) open. A key without pieces is not listed."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    open_ = F.col("start") > F.coalesce(before, F.col("req_start"))
    marked = pieces.withColumn("_open", open_ & (F.col("start") < F.col("req_end")) & (F.coalesce(before, F.col("req_start")) < F.col("req_end")))
    return marked.groupBy(*keys).agg((F.bool_or("_open") | (F.max("end") < F.max("req_end"))).alias("gap"))


def committed_receipts(receipts: DataFrame, chunks: DataFrame, intents: DataFrame, runs: DataFrame) -> DataFrame:
    """Receipts of complete chunks with a committed intent, in runs that are known."""
    done = chunks.where("state = 'complete'").join(runs.select("run_id"), "run_id").select("chunk_id", "run_id")
    return receipts.join(done, "chunk_id").join(intents.where("committed").select("receipt_id").distinct(), "receipt_id")


def resolved_platform(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """key, platform, reason: pointers of each document must resolve, and to exactly one platform.

    ``docs`` has key and pointers (array), ``metadata`` pointer and platform. Reasons: missing_metadata,
    unresolved_metadata, conflicting_platform.
    """
    listed = docs.select("key", F.explode_outer("pointers").alias("pointer")).join(metadata.withColumn("_known", F.lit(True)), "pointer", "left")
    each = listed.groupBy("key").agg(
        F.count("pointer").alias("given"), F.count_if(F.col("pointer").isNotNull() & F.col("_known").isNull()).alias("lost"), F.min("platform").alias("lo"), F.max("platform").alias("hi")
    )
    reason = F.when(F.col("given") == 0, "missing_metadata").when(F.col("lost") > 0, "unresolved_metadata").when(F.col("lo") != F.col("hi"), "conflicting_platform")
    return each.select("key", F.when(reason.isNull(), F.col("lo")).alias("platform"), reason.alias("reason"))


def identity_action() -> Column:
    """Action of a candidate from by_id, by_natural (what it matches), stable (its id) and natural_stable (the id of what it matches by key)."""
    has_id, has_natural, given = F.col("by_id").isNotNull(), F.col("by_natural").isNotNull(), F.col("stable").isNotNull()
    return (
        F.when(has_id & has_natural & (F.col("by_id") != F.col("by_natural")), "conflict").when(has_id, "match_stable_id")
        .when(has_natural & given & F.col("natural_stable").isNull(), "attach_stable_alias").when(has_natural & given, "conflict")
        .when(has_natural, "match_natural_key").otherwise("insert_identity")
    )


def match_identity(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """``candidates`` (stable, natural, ...) with matched and action, against ``stored`` (stored, stable, natural)."""
    by_id = stored.where("stable IS NOT NULL").select("stable", F.col("stored").alias("by_id"))
    by_natural = stored.select("natural", F.col("stored").alias("by_natural"), F.col("stable").alias("natural_stable"))
    both = candidates.join(by_id, "stable", "left").join(by_natural, "natural", "left")
    return both.withColumns({"matched": F.coalesce("by_id", "by_natural"), "action": identity_action()}).drop("by_id", "by_natural", "natural_stable")


def content_check(content: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, levels, differing: arrays of canonical level structs (column ``content``) against typed rows (key, i, fields), null-safe field by field."""
    listed = content.select(key, F.posexplode("content").alias("i", "_x")).select(key, "i", F.col("_x").alias("_c"))
    both = rows.withColumn("_row", F.lit(True)).join(listed, [key, "i"], "full")
    same = F.col("_row").isNotNull() & F.col("_c").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col("_c")[f])
    return both.groupBy(key).agg(F.count("*").alias("levels"), F.count_if(~same).alias("differing"))


def audited(content: DataFrame, rows: DataFrame, key: str, fields: list[str], n: int) -> DataFrame:
    """``content_check`` of the first ``n`` keys by md5: the same sample at every run."""
    sample = content.select(key).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(n)
    return content_check(content.join(sample, key, "left_semi"), rows.join(sample, key, "left_semi"), key, fields)


def quarantined_slots(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct slots that a closed run has quarantined."""
    return attempts.where("quarantined").join(runs.where("closed").select("run_id"), "run_id", "left_semi").select("slot").distinct()


def part_gaps(parts: DataFrame, bad: Column, slot: list[str]) -> DataFrame:
    """slot columns, parts, gap: one part that cannot be read makes its slot a gap."""
    return parts.groupBy(*slot).agg(F.count("*").alias("parts"), F.bool_or(bad).alias("gap"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """column, cells, differing, only_one, worst: the cells of two results, by keys; worst is the largest relative difference."""
    both = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values]).join(b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values]), keys, "full")
    cells = both.select(F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"_a_{v}").cast("double").alias("x"), F.col(f"_b_{v}").cast("double").alias("y")) for v in values])).alias("c")).select("c.*")
    gap = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("x"), F.abs("y"), F.lit(1e-300))
    return cells.groupBy("column").agg(
        F.count("*").alias("cells"), F.count_if(gap > tolerance).alias("differing"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("only_one"), F.max(gap).alias("worst")
    )
