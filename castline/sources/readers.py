"""Readers of files and raw records, each a function from a path or DataFrame to a DataFrame.

Schemas are explicit everywhere; nothing is inferred. Numbers arrive as text where the source writes
them as text, and the spellings of missing values become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castline.functions.geo import in_bbox, tile_key
from castline.functions.numeric import number
from castline.functions.qc import VARIABLES, place_variant

VARIANT = ("{v}", "{v}_adjusted", "{v}_qc", "{v}_adjusted_qc", "{v}_data_mode")
#: The 17 columns of a level part that queries read.
PART_COLUMNS = ["profile_id", "profile_hash", *[c.format(v=v) for v in VARIABLES for c in VARIANT]]
PART_SCHEMA = "profile_id string, profile_hash string, level_index int, " + ", ".join(
    f"{c.format(v=v)} {'double' if c in VARIANT[:2] else 'string'}" for v in VARIABLES for c in VARIANT
)
INDEX_SCHEMA = "file string, date string, latitude string, longitude string, ocean string, profiler_type string, institution string, date_update string"
SNAPSHOT_SCHEMA = (
    "platform_number string, date timestamp, date_qc long, cycle_number long, direction string, position_qc long, "
    "lon double, lat double, temp double, psal double, pres double"
)


def read_parts(spark: SparkSession, paths: list[str] | str, columns: list[str] | None = None) -> DataFrame:
    """Level parts in their fixed schema, only the columns asked for (PART_COLUMNS unless given)."""
    return spark.read.schema(PART_SCHEMA).parquet(*([paths] if isinstance(paths, str) else paths)).select(*(columns or PART_COLUMNS))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The flat level snapshot, 11 columns."""
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(path)


def manifest_members(manifest: DataFrame) -> DataFrame:
    """profile_id, profile_hash of every member: of manifests as rows, or as written lists (column ``members``)."""
    if "members" in manifest.columns:
        manifest = manifest.select(F.explode("members").alias("m")).select("m.*")
    return manifest.select("profile_id", "profile_hash")


def members(profiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """The profiles that a slot's manifest lists with the hash they have now."""
    return profiles.join(manifest_members(manifest), ["profile_id", "profile_hash"], "left_semi")


def active_parts(parts: DataFrame, commits: DataFrame, slots: DataFrame) -> DataFrame:
    """Parts in state ``active`` with a committed intent, written at the slot's current version."""
    live = parts.where("state = 'active'").join(commits.where("committed").select("part_id"), "part_id", "left_semi")
    return live.join(slots.select("logical_key", "slot_version"), ["logical_key", "slot_version"], "left_semi")


def read_profile_index(spark: SparkSession, path: str, start: str, end: str, box: tuple[float, float, float, float]) -> DataFrame:
    """file, date, latitude, longitude of an index of comma lines with ``#`` comments and a header line.

    ``start`` and ``end`` are yyyyMMddHHmmss, half-open, compared as text of fixed width. Lines without a
    date or position are skipped. A compressed index is one task; what is kept of it is dealt out anew.
    """
    lines = spark.read.schema(INDEX_SCHEMA).option("comment", "#").csv(path)
    at = lines.where(F.col("date").rlike("^[0-9]{14}$") & (F.col("date") >= start) & (F.col("date") < end))
    at = at.select("file", "date", F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"))
    found = at.where(in_bbox(*box))  # a null position is in no box
    return found.repartition("file") if path.endswith(".gz") else found


def index_entries(index: DataFrame, start: str, end: str, tile: str) -> DataFrame:
    """Lines of a time interval that a tile owns, by date and file."""
    own = (F.col("date") >= start) & (F.col("date") < end) & (tile_key(F.col("longitude"), F.col("latitude")) == tile)
    return index.where(own).orderBy("date", "file")


def daily_keys(start: Column, end: Column) -> Column:
    """Array with an object key for each UTC day that the half-open interval touches."""
    start, end = start.cast("timestamp"), end.cast("timestamp")
    last = F.to_date(F.timestamp_micros(F.unix_micros(end) - 1))
    days = F.sequence(F.to_date(start), last, F.expr("interval 1 day"))
    return F.when(end > start, F.transform(days, lambda d: F.concat(F.date_format(d, "yyyy/MM/yyyyMMdd"), F.lit("_prof.nc")))).otherwise(F.array().cast("array<string>"))


DOCUMENT_SCHEMA = (
    "_id string, timestamp string, cycle_number long, geolocation struct<type: string, coordinates: array<double>>, metadata array<string>, "
    "data_info array<string>, data array<array<string>>"
)


def parsed(docs: DataFrame, column: str = "json") -> DataFrame:
    """The fields of column-oriented profile documents, with names, units, modes and the data by name."""
    d = docs.select(F.from_json(column, DOCUMENT_SCHEMA).alias("d")).select("d.*").withColumn("names", F.from_json(F.col("data_info")[0], "array<string>"))
    attributes, values = F.from_json(F.col("data_info")[1], "array<string>"), F.from_json(F.col("data_info")[2], "array<array<string>>")
    at = lambda name: F.array_position(attributes, name).cast("int") - 1
    by = lambda name: F.map_from_arrays(F.col("names"), F.transform(values, lambda v: F.get(v, at(name))))
    return d.withColumns({"units": by("units"), "modes": by("data_keys_mode"), "by_name": F.map_from_arrays("names", "data")})


def flatten_profiles(docs: DataFrame, column: str = "json") -> DataFrame:
    """profile_id, level_index and the 15 value columns: one row for each level of the documents.

    A delivered value and its QC go to the original columns in mode R and to the adjusted ones in A and D.
    """
    arrays = {n: F.coalesce(F.col("by_name")[n], F.array().cast("array<string>")) for v in VARIABLES for n in (v, f"{v}_argoqc")}
    zipped = F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])
    rows = parsed(docs, column).select(F.col("_id").alias("profile_id"), "modes", F.posexplode(zipped).alias("level_index", "x"))
    out = [c for v in VARIABLES for c in place_variant(v, number(F.col("x")[v]), F.col("x")[f"{v}_argoqc"], F.col("modes")[v])]
    return rows.select("profile_id", "level_index", *out)


# The names under which the older form delivers the three variables.
LEGACY_NAMES = {"pressure": ("pres", "PRES", "pressure"), "temperature": ("temp", "TEMP", "temperature"), "salinity": ("psal", "PSAL", "salinity")}


def flatten_measurements(docs: DataFrame, column: str = "measurements") -> DataFrame:
    """The other columns, level_index, pressure, temperature, salinity of the older form.

    ``column`` is JSON text: a list with an object for each level, or an object with an array for each name.
    A document without levels keeps one row of nulls.
    """
    rest = [c for c in docs.columns if c != column]
    first = lambda get: [F.coalesce(*[get(n) for n in LEGACY_NAMES[v]]) for v in VARIABLES]
    triple = lambda get: F.struct(*[number(c).alias(v) for c, v in zip(first(get), VARIABLES, strict=True)])
    listed = F.transform(F.from_json(column, "array<map<string,string>>"), lambda m: triple(lambda n: m[n]))
    by_name = F.from_json(column, "map<string,array<string>>")
    size = F.greatest(F.lit(0), *[F.coalesce(F.size(by_name[n]), F.lit(0)) for names in LEGACY_NAMES.values() for n in names])
    index = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    columns = F.transform(index, lambda i: triple(lambda n: F.get(by_name[n], i)))
    levels = F.when(F.ltrim(column).startswith("["), listed).otherwise(columns)
    return docs.select(*rest, F.posexplode_outer(levels).alias("level_index", "x")).select(*rest, "level_index", *[F.col("x")[v].alias(v) for v in VARIABLES])


FILL = 99999.0


def _usable(x: Column) -> Column:
    return x.isNotNull() & (x != FILL)


def array_exclusion(df: DataFrame) -> DataFrame:
    """``df`` with ``last``, the last index at which an array holds a value, and ``excluded``: why a profile has no rows, or null."""
    arrays = ("pressure", "temperature", "salinity")
    held = lambda c: F.array_max(F.transform(c, lambda x, i: F.when(_usable(x), i)))
    df = df.withColumn("last", F.greatest(*[held(c) for c in arrays]))
    reason = F.when(~F.coalesce(_usable(F.col("latitude")) & _usable(F.col("longitude")), F.lit(False)), "no_position")
    return df.withColumn("excluded", reason.when(~F.coalesce(_usable(F.col("juld")), F.lit(False)), "no_time").when(F.col("last").isNull(), "no_level"))


def trim_profile_arrays(df: DataFrame) -> DataFrame:
    """profile_id, level_index, pressure, temperature, salinity of wide per-profile arrays with fill values.

    Profiles without position, time or level are left out; each array is cut behind the last level that
    holds a value; fill values become null.
    """
    kept = array_exclusion(df).where("excluded IS NULL")
    cut = F.arrays_zip(*[F.slice(c, F.lit(1), F.col("last") + 1).alias(c) for c in VARIABLES[:1] + ("temperature", "salinity")])
    rows = kept.select("profile_id", F.posexplode(cut).alias("level_index", "x"))
    return rows.select("profile_id", "level_index", *[F.when(_usable(F.col("x")[v]), F.col("x")[v]).alias(v) for v in ("pressure", "temperature", "salinity")])


def read_regions(df: DataFrame) -> DataFrame:
    """name, wkt, verdict of region records: ``ok``, ``digest_mismatch`` or ``duplicate_name``."""
    repeated = df.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name", F.lit(True).alias("_twice"))
    wrong = ~F.coalesce(F.sha2("wkt", 256) == F.col("sha256"), F.lit(False))
    return df.join(repeated, "name", "left").select("name", "wkt", F.when(wrong, "digest_mismatch").when(F.col("_twice"), "duplicate_name").otherwise("ok").alias("verdict"))
