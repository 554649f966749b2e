"""Views that give the driver tables the shapes of profiles and levels.

orders plays profile, lineitem level, customer float, events the event log, documents and
embeddings the text corpus, labels the gold scores. The same text defines the views for Spark and,
as a WITH prefix, for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PROFILES = """SELECT CAST(o_orderkey AS STRING) AS profile_id, CAST(o_custkey AS STRING) AS platform_number,
  o_orderkey % 400 AS cycle_number,
  CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'D' ELSE 'U' END AS direction,
  o_orderdate AS observed_at, CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_month,
  20 + ((o_orderkey * 7919) % 10001) / 100e0 AS longitude,
  -60 + ((o_orderkey * 104729) % 9001) / 100e0 AS latitude,
  md5(concat(CAST(o_orderkey AS STRING), '|', o_orderstatus, '|', o_orderpriority)) AS profile_hash
FROM orders"""

DELIVERED = """SELECT CAST(l_orderkey AS STRING) AS profile_id,
  row_number() OVER (PARTITION BY CAST(l_orderkey AS STRING) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS level_index,
  CASE l_returnflag WHEN 'N' THEN 'R' WHEN 'A' THEN 'A' ELSE 'D' END AS data_mode,
  l_quantity * 40 AS p, l_extendedprice / 3500e0 AS t, 30 + l_discount * 50 AS s,
  CAST(1 + l_partkey % 5 AS STRING) AS p_qc, CAST(1 + l_suppkey % 4 AS STRING) AS t_qc, CAST(1 + l_linenumber % 3 AS STRING) AS s_qc
FROM lineitem"""

_VARIABLES = (("pressure", "p"), ("temperature", "t"), ("salinity", "s"))

LEVELS = "SELECT profile_id, level_index,\n  " + ",\n  ".join(
    f"CASE WHEN data_mode = 'R' THEN {c} END AS {v}, CASE WHEN data_mode <> 'R' THEN {c} END AS {v}_adjusted, "
    f"CASE WHEN data_mode = 'R' THEN {c}_qc END AS {v}_qc, CASE WHEN data_mode <> 'R' THEN {c}_qc END AS {v}_adjusted_qc, data_mode AS {v}_data_mode"
    for v, c in _VARIABLES
) + "\nFROM b_delivered"

#: Positions all over the globe, as the profiles' lie within one envelope.
GLOBE = "SELECT profile_id, observation_month, ((CAST(profile_id AS BIGINT) * 7919) % 36001) / 100e0 - 180 AS longitude, ((CAST(profile_id AS BIGINT) * 104729) % 18001) / 100e0 - 90 AS latitude FROM b_profiles"

VIEWS = {"b_profiles": PROFILES, "b_delivered": DELIVERED, "b_levels": LEVELS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """profiles, delivered and levels as DataFrames over the tables in ``sf_dir``; no catalogue entry is left behind."""
    profiles = spark.sql(PROFILES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    delivered = spark.sql(DELIVERED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    levels = spark.sql(LEVELS.replace("FROM b_delivered", "FROM {b_delivered}"), b_delivered=delivered)
    return {"profiles": profiles, "delivered": delivered, "levels": levels}


def globe(t) -> DataFrame:
    """GLOBE over the profiles of ``t``."""
    k = F.col("profile_id").cast("long")
    return t.profiles.select("profile_id", "observation_month", ((k * 7919) % 36001 / 100.0 - 180).alias("longitude"), ((k * 104729) % 18001 / 100.0 - 90).alias("latitude"))


def with_views(sql: str, **more: str) -> str:
    """``sql`` behind a WITH prefix that defines the bridge views that it names."""
    views, used = VIEWS | more, []

    def need(text: str) -> None:
        for name in views:
            if name in text and name not in used:
                need(views[name])
                used.append(name)

    need(sql)
    prefix = ",\n".join(f"{n} AS ({views[n]})" for n in used)
    if not prefix:
        return sql
    body = sql.strip()
    return f"WITH {prefix},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {prefix}\n{body}"
