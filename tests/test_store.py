"""The slot store: what a plan reads of it, and that it gives the same rows as the frames it was written from."""

import re

import pytest
from pyspark.sql import functions as F

from castline.functions.geo import box_tile_keys, in_bbox, tile_key
from castline.plans import document
from castline.queries.plans import MONTHLY, PAGE
from castline.registry import Tables
from castline.sources.store import open_store, write_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def _scans(df):
    return re.findall(r"\(\d+\) Scan parquet.*?(?=\n\n)", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), re.S)


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("plan", [MONTHLY, MONTHLY | {"operation": {"kind": "aggregate", "group_by": ["float", "day"], "metrics": ["mean", "median", "count"]}}, PAGE, MONTHLY | {"geography": {"kind": "point_radius", "longitude": 72.5, "latitude": -5.0, "radius_km": 1500}}])
def test_a_plan_over_the_store_reads_its_months_and_gives_the_same_rows(tables, plan):
    stored = document.run_plan(plan, tables.store.profiles, tables.store.levels)
    for scan in [x for x in _scans(stored) if "store-" in x]:
        assert "PartitionFilters: [" in scan and "1996-01-01" in scan and "1996-12-01" in scan, scan
    whole = document.run_plan(plan, tables.profiles, tables.levels)
    assert _rows(stored.select(*whole.columns).select(*[F.round(c, 9) if k == "double" else F.col(c) for c, k in whole.dtypes])) == _rows(whole.select(*[F.round(c, 9) if k == "double" else F.col(c) for c, k in whole.dtypes]))


def test_only_selected_slots_are_read(tables):
    plan = MONTHLY | {"time_range": {"start": "1996-03-05T00:00:00Z", "end": "1996-04-01T00:00:00Z"}}
    scans = _scans(document.run_plan(plan, tables.store.profiles, tables.store.levels))
    levels = [x for x in scans if "level_index" in x or "pressure" in x]
    assert levels and all("1996-03-01" in x.split("PartitionFilters")[1] and "tile" in x.split("PushedFilters")[1] for x in levels), scans


def test_a_slot_without_headers_or_levels(spark, tables, tmp_path):
    none = write_store(tables.profiles.where("false"), tables.levels, str(tmp_path / "a"))
    assert none.profiles.count() == 0 and none.selected(headers=("platform_number",)).count() == 0
    write_store(tables.profiles.where("observation_month < DATE'1993-01-01'"), tables.levels.where("profile_id = '1'"), str(tmp_path / "b"))
    store = open_store(spark, str(tmp_path / "b"), none.profiles.schema, none.levels.schema)
    assert store.profiles.count() == tables.profiles.where("observation_month < DATE'1993-01-01'").count() and store.selected(headers=("platform_number",)).count() == store.levels.count()


def test_tile_keys_of_a_box_hold_every_point(spark):
    points = spark.range(0, 40000).select((F.col("id") * 7919 % 3601 / 10 - 180).alias("longitude"), (F.col("id") * 104729 % 1801 / 10 - 90).alias("latitude"))
    for box in [(40, -30, 90, 25), (170, -80, -170, 80), (120, 30, 130, 40), (20, -60, 20.5, -59), (110, 0, 120, 30), (-180, -90, 180, 89)]:
        keys = points.where(in_bbox(*box)).select(tile_key(F.col("longitude"), F.col("latitude"))).distinct()
        assert {r[0] for r in keys.collect()} <= set(box_tile_keys(*box))
    assert box_tile_keys(-180, -90, 180, 90) == []
