"""Compaction of level parts: many parts of a slot become one snapshot, audited before readers see it.

Layout under a path: ``data/generation=N`` holds parts as they were committed, ``manifest/version=V`` says for each slot
which generations hold it, and ``published`` lists the versions that count, one small file each. A version is listed last, in
one write, so a reader sees the version before or the version after, whatever fails in between. Old files stay
for readers that hold the old version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("profile_id", "level_index")
SLOT = "slot"


class AuditError(ValueError):
    """Rows differ before and after; nothing was published."""


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("version long, slots long").parquet(f"{path}/published")


def current_version(spark: SparkSession, path: str) -> int:
    return _versions(spark, path).agg(F.max("version")).first()[0]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """slot, generation of a version (the current one unless given)."""
    version = current_version(spark, path) if version is None else version
    return spark.read.schema(f"{SLOT} string, generation long").parquet(f"{path}/manifest/version={version}")


def _publish(listed: DataFrame, path: str, version: int) -> None:
    spark = listed.sparkSession
    listed.select(SLOT, "generation").write.parquet(f"{path}/manifest/version={version}")
    slots = manifest(spark, path, version).agg(F.count_distinct(SLOT).alias("slots"))
    slots.select(F.lit(version).cast("long").alias("version"), "slots").coalesce(1).write.mode("append").parquet(f"{path}/published")


def commit_part(rows: DataFrame, path: str, generation: int) -> None:
    """Add a part: rows of some slots (column ``slot``) that stand beside those of the generations before."""
    spark = rows.sparkSession
    rows.hint("rebalance", SLOT).write.option("compression", "zstd").parquet(f"{path}/data/generation={generation}")
    held = read_generation(spark, path, generation, rows.schema).select(SLOT).distinct().withColumn("generation", F.lit(generation).cast("long"))
    if generation:
        held = manifest(spark, path).unionByName(held)
    _publish(held, path, 0 if not generation else current_version(spark, path) + 1)


def read_generation(spark: SparkSession, path: str, generation: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/data/generation={generation}")


def read_current(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """Rows of all parts of a version, with their generation: a join of (slot, generation), and a scan of the generations it lists."""
    listed = manifest(spark, path, version)
    generations = sorted(r[0] for r in listed.select("generation").distinct().collect())
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/generation={g}" for g in generations])
    return rows.withColumn("generation", F.col("generation").cast("long")).join(listed, [SLOT, "generation"], "left_semi")


def newest(rows: DataFrame) -> DataFrame:
    """Of parts that hold the same profile the newest counts, whole: a revision replaces all levels of its profile."""
    last = rows.groupBy(SLOT, "profile_id").agg(F.max("generation").alias("generation"))
    return rows.join(last, [SLOT, "profile_id", "generation"], "left_semi")


def digests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """slot, n, profiles, digest: counts of each slot and a sum of its rows' hashes, whatever their order."""
    cells = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)])
    each = F.conv(F.substring(F.sha2(cells, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    one = rows.groupBy(SLOT, "profile_id").agg(F.count("*").alias("n"), F.sum(each).alias("h"))
    return one.groupBy(SLOT).agg(F.sum("n").alias("n"), F.count("*").alias("profiles"), F.sum("h").alias("digest"))


def compact(spark: SparkSession, path: str, schema, members: DataFrame, least_parts: int = 2, rewrite=lambda rows: rows) -> DataFrame:
    """Rewrite every slot of ``least_parts`` parts or more as one part; returns slot, parts, n, profiles, digest of the slots rewritten.

    ``members``: slot, profile_id of what is listed; rows of profiles that no longer are stay behind. The rewritten slots are read
    back and held against what readers see before; if one differs, AuditError, and the version stays. ``rewrite`` is for tests.
    """
    version = current_version(spark, path)
    listed = manifest(spark, path, version)
    many = listed.groupBy(SLOT).agg(F.count("*").alias("parts")).where(F.col("parts") >= least_parts)
    columns = [f.name for f in schema]
    before = newest(read_current(spark, path, schema, version).join(many, SLOT, "left_semi")).join(members, [SLOT, "profile_id"], "left_semi")
    generation = listed.agg(F.max("generation")).first()[0] + 1
    while True:  # a number that an attempt before used up stays unused
        try:
            rewrite(before.select(*columns)).repartitionByRange(SLOT, *KEY).sortWithinPartitions(SLOT, *KEY).write.option("compression", "zstd").parquet(f"{path}/data/generation={generation}")
            break
        except Exception as e:  # noqa: BLE001
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            generation += 1
    after = digests(read_generation(spark, path, generation, schema), columns)
    both = digests(before, columns).select(SLOT, F.struct("n", "profiles", "digest").alias("b")).join(after.select(SLOT, F.struct("n", "profiles", "digest").alias("a")), SLOT, "full")
    wrong = both.where(~F.col("a").eqNullSafe(F.col("b"))).limit(5).collect()
    if wrong:
        raise AuditError(f"slots differ: {[r[SLOT] for r in wrong]}")
    swapped = listed.join(many, SLOT, "left_anti").unionByName(many.select(SLOT, F.lit(generation).cast("long").alias("generation")))
    _publish(swapped, path, version + 1)
    return after.join(many, SLOT).select(SLOT, "parts", "n", "profiles", "digest")
