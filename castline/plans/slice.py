"""The flagship query: monthly profile-balanced mean of temperature in a box and a depth band."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.bridge import frames, with_views
from castline.functions.qc import qc_value


def monthly_mean(spark, sf_dir):
    f = frames(spark, sf_dir)
    heads = f["profiles"].where(
        (F.col("observed_at") >= F.lit("1996-01-01").cast("timestamp"))
        & (F.col("observed_at") < F.lit("1997-01-01").cast("timestamp"))
        & F.col("longitude").between(40, 90)
        & F.col("latitude").between(-30, 25)
    ).select("profile_id", F.date_format("observation_month", "yyyy-MM").alias("month"))
    levels = f["levels"].select("profile_id", qc_value("pressure", "science_ready").alias("p"), qc_value("temperature", "science_ready").alias("t"))
    each = levels.where(F.col("p").between(0, 1000)).join(heads, "profile_id").groupBy("profile_id", "month").agg(F.avg("t").alias("t"))
    return each.groupBy("month").agg(
        F.round(F.avg("t"), 6).alias("m"), F.count("t").alias("c"), F.round(F.stddev_samp("t"), 6).alias("sd")
    )


QUERIES = {"slice_monthly_mean": monthly_mean}

SQL = {
    "slice_monthly_mean": with_views("""
WITH v AS (SELECT m.profile_id, substr(CAST(m.observation_month AS STRING),1,7) AS month,
  CASE WHEN pressure_data_mode='R' AND pressure_qc IN ('1','2') THEN pressure WHEN pressure_data_mode IN ('A','D') AND pressure_adjusted_qc IN ('1','2') THEN pressure_adjusted END AS p,
  CASE WHEN temperature_data_mode='R' AND temperature_qc IN ('1','2') THEN temperature WHEN temperature_data_mode IN ('A','D') AND temperature_adjusted_qc IN ('1','2') THEN temperature_adjusted END AS t
  FROM b_levels l JOIN b_profiles m ON l.profile_id=m.profile_id
  WHERE m.observed_at >= TIMESTAMP '1996-01-01' AND m.observed_at < TIMESTAMP '1997-01-01' AND longitude BETWEEN 40 AND 90 AND latitude BETWEEN -30 AND 25),
 q AS (SELECT profile_id, month, avg(t) AS t FROM v WHERE p BETWEEN 0 AND 1000 GROUP BY profile_id, month)
SELECT month, round(avg(t),6) AS m, count(t) AS c, round(stddev_samp(t),6) AS sd FROM q GROUP BY month""")
}
