"""Writers: level parts by slot, exports with a manifest beside them, corpus upserts, and proof of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.functions.qc import VARIABLES, qc_value

# Unit of each variable.
UNITS = {"pressure": "dbar", "temperature": "degree_C", "salinity": "1"}
HEADER = ("profile_id", "platform_number", "cycle_number", "direction", "observed_at", "longitude", "latitude")
AUDIT = ("{v}", "{v}_adjusted", "{v}_qc", "{v}_adjusted_qc", "{v}_data_mode")


def write_levels(levels: DataFrame, path: str, month: str = "observation_month", tile: str = "tile") -> None:
    """Level Parquet by month and tile, sorted by profile and level.

    Rows are rebalanced by slot: small slots share a task, and a slot beyond a task's size is split over
    several files, so a hot slot is never one task.
    """
    dealt = levels.hint("rebalance", month, tile).sortWithinPartitions(month, tile, "profile_id", "level_index")
    dealt.write.partitionBy(month, tile).option("compression", "zstd").parquet(path)


def unit_for(column: str) -> str | None:
    """Unit of a result column by its variable; none for counts, QC codes and modes."""
    if column.endswith(("_count", "_qc", "_mode")):
        return None
    return next((u for v, u in UNITS.items() if column == v or column.startswith(f"{v}_")), None)


def export_columns(policy: str) -> list[Column]:
    """The header, the level, and for each variable the selected value and the five stored columns it was chosen from."""
    each = [[qc_value(v, policy).alias(f"{v}_selected"), *[F.col(c.format(v=v)) for c in AUDIT]] for v in VARIABLES]
    return [*map(F.col, HEADER), F.col("level_index"), *[c for columns in each for c in columns]]


def export_levels(levels: DataFrame, profiles: DataFrame, path: str, fmt: str, policy: str = "science_ready") -> None:
    """One row for each level, by time, profile and level, as ``parquet`` or ``csv`` with a header, also when it is empty."""
    rows = levels.join(profiles.select(*HEADER), "profile_id").select(*export_columns(policy)).orderBy("observed_at", "profile_id", "level_index")
    writer = rows.write
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif fmt != "parquet":
        raise ValueError(f"unknown format {fmt!r}")
    writer.format(fmt).save(path)


def export_manifest(rows: DataFrame, path: str, plan_sha256: str) -> None:
    """One JSON line beside the data: rows, distinct profiles, time covered, units of the columns, plan digest."""
    units = {c: u for c in rows.columns if (u := unit_for(c))}
    made = rows.agg(F.count("*").alias("row_count"), F.countDistinct("profile_id").alias("profile_count"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))
    made = made.withColumns({"units": F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), "plan_sha256": F.lit(plan_sha256)})
    made.write.option("ignoreNullFields", False).json(path)


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """doc_type, key, model, content_sha256, action of every document of either side.

    ``embed`` and ``embed_again`` need a new embedding (new, or another content), ``keep`` does not, and
    ``retire`` is no longer delivered.
    """
    ids = ["doc_type", "key", "model"]
    a, b = current.select(*ids, F.col("content_sha256").alias("old")), incoming.select(*ids, F.col("content_sha256").alias("new"))
    action = F.when(F.col("old").isNull(), "embed").when(F.col("new").isNull(), "retire").when(F.col("old") == F.col("new"), "keep").otherwise("embed_again")
    return a.join(b, ids, "full").select(*ids, F.coalesce("new", "old").alias("content_sha256"), action.alias("action"))


def digest(rows: DataFrame) -> DataFrame:
    """One row: count and an order-free digest of all rows (sums of two 64-bit hashes), for tables of any size."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.struct("*")).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("n"), h(1).alias("h1"), h(2).alias("h2"))


def verify_written(rows: DataFrame, path: str) -> DataFrame:
    """One row: rows missing from the written Parquet, rows there beyond them, and whether digests agree."""
    back = rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
    missing, extra = rows.exceptAll(back).agg(F.count("*").alias("missing")), back.exceptAll(rows).agg(F.count("*").alias("extra"))
    a, b = digest(rows).select(F.struct("*").alias("a")), digest(back).select(F.struct("*").alias("b"))
    return missing.join(extra, how="cross").join(a.join(b, how="cross"), how="cross").select("missing", "extra", (F.col("a") == F.col("b")).alias("same"))  # one row each
