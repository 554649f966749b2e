"""The slot store: headers and levels as Parquet by month, clustered by tile and profile.

A level row carries its profile's month and tile, so levels meet headers on (profile_id, observation_month, tile)
and a plan's time range prunes directories of both; its box prunes row groups by tile. Rows are dealt out by ranges of
(month, tile, profile), so the number of files follows the rows, and a hot slot becomes several files and tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from castline.functions.geo import tile_key
from castline.functions.qc import VARIABLES, qc_code, qc_value
from castline.scratch import new_path
from castline.sinks.writers import UNITS

SLOT = ("observation_month", "tile")


@dataclass(frozen=True)
class Store:
    profiles: DataFrame
    levels: DataFrame

    def selected(self, policy: str = "science_ready", headers: tuple[str, ...] = ()) -> DataFrame:
        """profile_id, level_index, month, tile, the values p, t, s that ``policy`` selects, and ``headers``; without any, headers are not read."""
        values = self.levels.select("profile_id", *SLOT, "level_index", *[qc_value(v, policy).alias(v[0]) for v in VARIABLES])
        return values.join(self.profiles.select("profile_id", *SLOT, *headers), ["profile_id", *SLOT]) if headers else values

    def profile_levels(self, profile_id: str, policy: str = "science_ready") -> DataFrame:
        """Levels of one profile in level order: value, QC code, mode and unit of each variable. Its header says which month is read."""
        head = self.profiles.where(F.col("profile_id") == profile_id).select("profile_id", *SLOT)
        rows = self.levels.where(F.col("profile_id") == profile_id).join(F.broadcast(head), ["profile_id", *SLOT])
        each = [c for v in VARIABLES for c in (qc_value(v, policy).alias(v), qc_code(v).alias(f"{v}_qc"), F.col(f"{v}_data_mode").alias(f"{v}_mode"), F.lit(UNITS[v]).alias(f"{v}_unit"))]
        return rows.select("profile_id", "level_index", *each).orderBy("level_index")


def _written(rows: DataFrame, path: str, *order: str) -> None:
    dealt = rows.repartitionByRange(*SLOT, "profile_id").sortWithinPartitions(*SLOT, *order)
    dealt.write.partitionBy("observation_month").option("compression", "zstd").parquet(path)


def write_store(profiles: DataFrame, levels: DataFrame, path: str) -> Store:
    """Headers and levels under ``path``; levels without a header are left out, as nothing says where they belong."""
    heads = profiles.withColumn("tile", tile_key(F.col("longitude"), F.col("latitude")))
    rows = levels.join(heads.select("profile_id", *SLOT), "profile_id")
    _written(heads, f"{path}/profiles", "observed_at", "profile_id")
    _written(rows, f"{path}/levels", "profile_id", "level_index")
    return open_store(profiles.sparkSession, path, heads.schema, rows.schema)


def open_store(spark: SparkSession, path: str, profiles: StructType | None = None, levels: StructType | None = None) -> Store:
    """The store under ``path``; an empty one needs its schemas."""
    read = lambda name, schema: (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/{name}")
    return Store(read("profiles", profiles), read("levels", levels))


_LANDED: dict[tuple[str, str], Store] = {}


def landed_store(spark: SparkSession, name: str, profiles: DataFrame, levels: DataFrame) -> Store:
    """The store of the tables called ``name``, written in the shared folder when a session first asks for it."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _LANDED:
        _LANDED[key] = write_store(profiles, levels, new_path(spark, "store"))
    return _LANDED[key]
