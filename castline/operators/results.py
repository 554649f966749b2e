"""What leaves the store: results made safe to show, their summaries, chart series within bounds, tallies and traits of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castline.functions.numeric import finite
from castline.functions.qc import VARIABLES, qc_code, qc_value

# The longest text of a cell, texts that tell of internals, and the types that a column of a result may have.
MOST_TEXT = 512
FORBIDDEN = r"(?i)(normalised/|raw/sha256|s3://|postgres(ql)?://|minio|traceback|\bselect\b|\binsert\b|password|secret)"
KINDS = {
    "string": (T.StringType,), "integer": (T.IntegralType,), "number": (T.IntegralType, T.FractionalType), "boolean": (T.BooleanType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType), "date": (T.DateType,),
}


def sanitize(df: DataFrame, columns: dict[str, str], most_rows: int, most_text: int = MOST_TEXT) -> tuple[DataFrame, DataFrame]:
    """(the rows with numbers that are not finite as null, one row: rows, non_finite, too_long, internal, verdict).

    ``columns`` names every column with its kind (KINDS); other names or types are a ValueError, before anything runs. The verdict is
    ``result_too_large`` beyond ``most_rows``, else ``internal_error`` if any text is too long or tells of internals, else null.
    """
    if list(df.columns) != list(columns):
        raise ValueError(f"columns are {df.columns}, not {list(columns)}")
    for field in df.schema.fields:
        if not isinstance(field.dataType, KINDS[columns[field.name]]):
            raise ValueError(f"{field.name} is {field.dataType.simpleString()}, not {columns[field.name]}")
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    texts = [n for n, kind in columns.items() if kind == "string"]
    clean = df.withColumns({c: finite(F.col(c)) for c in floats}) if floats else df
    added = lambda parts: sum(parts, F.lit(0).cast("long"))
    lost = added([F.count_if(F.col(c).isNotNull() & finite(F.col(c)).isNull()) for c in floats])
    long = added([F.count_if(F.char_length(c) > most_text) for c in texts])
    internal = added([F.count_if(F.col(c).rlike(FORBIDDEN)) for c in texts])
    audit = df.agg(F.count("*").alias("rows"), lost.alias("non_finite"), long.alias("too_long"), internal.alias("internal"))
    verdict = F.when(F.col("rows") > most_rows, "result_too_large").when(F.col("too_long") + F.col("internal") > 0, "internal_error")
    return clean, audit.withColumn("verdict", verdict)


def _rows_of(one: DataFrame, names: list[str]) -> DataFrame:
    """The struct columns ``names`` of a one-row frame as rows."""
    return one.select(F.explode(F.array(*[F.col(n) for n in names])).alias("_r")).select("_r.*")


def summarize(df: DataFrame) -> DataFrame:
    """column, lo, hi, mean, n for each numeric column of ``df``, in one pass; a column without values has nulls and 0."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.FractionalType))]
    if not numeric:
        raise ValueError("no numeric column")
    value = lambda c: F.col(c).cast("double")
    stats = [F.struct(F.lit(c).alias("column"), F.min(value(c)).alias("lo"), F.max(value(c)).alias("hi"), F.avg(value(c)).alias("mean"), F.count(c).alias("n")).alias(f"_{i}") for i, c in enumerate(numeric)]
    return _rows_of(df.agg(*stats), [f"_{i}" for i in range(len(numeric))])


def first_rows(df: DataFrame, *order: str, n: int = 12) -> DataFrame:
    """The first ``n`` rows, as a summary shows them."""
    return df.orderBy(*order).limit(n)


def series_points(df: DataFrame, x: str, series: str | None, metrics: tuple[str, ...]) -> DataFrame:
    """metric, series, x, y: a row for each point, one series for each metric and value of the second key; a null y is a gap that is kept."""
    other = F.col(series).cast("string") if series else F.lit(None).cast("string")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics])
    return df.select(other.alias("series"), F.col(x).alias("x"), F.explode(each).alias("_m")).select("_m.metric", "series", "x", "_m.y")


def series_bounds(points: DataFrame, most_points: int, most_series: int) -> DataFrame:
    """n_series, longest, verdict (``result_too_large`` or null): one row, of ``series_points``."""
    made = points.groupBy("metric", "series").agg(F.count("*").alias("_n")).agg(F.count("*").alias("n_series"), F.coalesce(F.max("_n"), F.lit(0)).alias("longest"))
    return made.withColumn("verdict", F.when((F.col("longest") > most_points) | (F.col("n_series") > most_series), "result_too_large"))


def qc_mode_tally(levels: DataFrame, policy: str) -> DataFrame:
    """variable, kind, code, n: values that ``policy`` keeps (kind ``kept``, no code), and how often each mode and QC code comes.

    Levels are counted by their combination of codes first, which are few, so that no level is repeated for each tally.
    """
    columns = [c for v in VARIABLES for c in (qc_value(v, policy).isNotNull().alias(f"{v}_kept"), F.col(f"{v}_data_mode").alias(f"{v}_mode"), qc_code(v).alias(f"{v}_code"))]
    combined = levels.select(*columns).groupBy(*[f"{v}_{x}" for v in VARIABLES for x in ("kept", "mode", "code")]).agg(F.count("*").alias("n"))
    row = lambda v, kind, code: F.struct(F.lit(v).alias("variable"), F.lit(kind).alias("kind"), code.alias("code"))
    none = F.lit(None).cast("string")
    tallies = [x for v in VARIABLES for x in (
        F.when(F.col(f"{v}_kept"), row(v, "kept", none)), F.when(F.col(f"{v}_mode").isNotNull(), row(v, "mode", F.col(f"{v}_mode"))), F.when(F.col(f"{v}_code").isNotNull(), row(v, "qc", F.col(f"{v}_code"))),
    )]
    return combined.select("n", F.explode(F.array_compact(F.array(*tallies))).alias("_t")).groupBy("_t.variable", "_t.kind", "_t.code").agg(F.sum("n").alias("n"))


def level_depth_stats(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, overall, profiles, unknown, levels, mean, least, most: levels a profile for each leaf (keys) and overall, from one shuffle.

    ``counts``: keys, levels (null: unknown). The overall row has null keys and ``overall`` true.
    """
    made = counts.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(
        (F.grouping_id() > 0).alias("overall"), F.count("*").alias("profiles"), F.count_if(F.col("levels").isNull()).alias("unknown"), F.coalesce(F.sum("levels"), F.lit(0)).cast("long").alias("levels_total"),
        F.avg("levels").alias("mean"), F.min("levels").alias("least"), F.max("levels").alias("most"),
    )
    return made.withColumnRenamed("levels_total", "levels")


def witness_matrix(df: DataFrame, key: str, traits: dict[str, Column]) -> DataFrame:
    """trait, witnesses, first (least key that shows it), gap (nothing does), in one pass. A trait that is null does not show."""
    found = [F.struct(F.lit(name).alias("trait"), F.count_if(c).alias("witnesses"), F.min(F.when(c, F.col(key))).alias("first"), (F.count_if(c) == 0).alias("gap")).alias(f"_{i}") for i, (name, c) in enumerate(traits.items())]
    return _rows_of(df.agg(*found), [f"_{i}" for i in range(len(traits))])
