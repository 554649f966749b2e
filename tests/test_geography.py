"""Circles, boxes and tiles over the whole globe against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from castline.catalogue import queries as registered
from castline.functions.geo import ENVELOPE, circle_boxes, geo_distance, tiles_of_boxes, within_km
from castline.operators.regions import counts_within, near_counts, near_pairs


def _globe(spark, n=4000):
    rng = random.Random(4)
    edges = [(-180.0, 0.0), (180.0, 0.0), (0.0, 90.0), (0.0, -90.0), (180.0, 90.0), (-180.0, -90.0), (179.999, 45.0), (-179.999, 45.0)]
    points = edges + [(round(rng.uniform(-180, 180), 3), round(rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), rng.uniform(-90, -85)]), 3)) for _ in range(n)]
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "id long, longitude double, latitude double").cache()


def _true(points, x, y, km):
    d = geo_distance(F.col("longitude"), F.col("latitude"), F.lit(x), F.lit(y))
    return {r.id for r in points.where(d <= km * 1000).collect()}


def test_circles_lose_no_point(spark):
    points = _globe(spark)
    for x, y, km in [(179.9, 0.0, 100.0), (-179.9, 0.0, 400.0), (0.0, 89.9, 50.0), (30.0, -89.0, 900.0), (-180.0, 60.0, 800.0), (180.0, -75.0, 2000.0), (20.0, 10.0, 1500.0), (5.0, 84.0, 640.0), (0.0, 90.0, 300.0)]:
        got = {r.id for r in points.where(within_km(x, y, km)).collect()}
        assert got == _true(points, x, y, km) and got, (x, y, km)


def test_hand_made_points_across_180_and_the_pole(spark):
    df = spark.createDataFrame([(-179.9, 0.0), (180.0, 89.9)], "longitude double, latitude double")
    assert df.where(within_km(179.9, 0, 100)).count() == 1 and df.where(within_km(0, 89.9, 100)).count() == 1


def test_pairs_over_the_globe(spark):
    points = _globe(spark, 1500)
    queries = points.where("id % 25 < 2").select(F.col("id").alias("q"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    got = {(r.q, r.id) for r in near_pairs(queries, points, 600).collect()}
    d = geo_distance(F.col("longitude"), F.col("latitude"), F.col("x"), F.col("y"))
    want = {(r.q, r.id) for r in queries.crossJoin(points).where(d <= 600_000).collect()}
    assert got == want and len(got) == near_pairs(queries, points, 600).count()


def test_boxes_and_tiles(spark):
    points = _globe(spark, 300)
    rows = points.select("longitude", "latitude", circle_boxes(F.col("longitude"), F.col("latitude"), F.lit(1100.0)).alias("b")).select("*", tiles_of_boxes(F.col("b")).alias("t")).collect()
    west0, south0, east0, north0 = ENVELOPE
    for r in rows:
        assert 1 <= len(r.b) <= 2 and all(-180 <= b.west <= b.east <= 180 and -90 <= b.south <= b.north <= 90 for b in r.b)
        want = set()
        for w in range(west0, east0, 10):
            for s in range(south0, north0, 10):
                for b in r.b:
                    x = b.east >= w and (b.west < w + 10 or (w == east0 - 10 and b.west <= east0))
                    y = b.north >= s and (b.south < s + 10 or (s == north0 - 10 and b.south <= north0))
                    if x and y:
                        want.add((w, s))
        assert {(c.west, c.south) for c in r.t} == want


def test_counts_are_those_of_the_pairs(spark):
    points = _globe(spark, 1500).withColumn("month", F.when(F.col("id") % 7 > 0, F.col("id") % 2))
    points = points.unionByName(spark.createDataFrame([(-1, None, 1.0, 0), (-3, 1.0, None, 0)], "id long, longitude double, latitude double, month long"))
    queries = points.where("id % 25 IN (0, 1)").select(F.col("id").alias("q"), F.col("longitude").alias("x"), F.col("latitude").alias("y"), "month")
    for km in (40, 600, 3000):
        want = {r.q: r.n for r in near_pairs(queries, points, km, ("month",)).groupBy("q").agg(F.count("*").alias("n")).collect()}
        for most in (200_000, 20):  # and strips in many groups
            assert {r.q: r.n for r in near_counts(queries, points, "q", km, ("month",), most).collect()} == want, (km, most)


@pytest.mark.parametrize("km", [0.001, 50.0, 900.0, 6000.0, 12000.0, 25000.0])
def test_counts_in_arrays_against_brute_force(spark, km):
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(-90, 90, 400), rng.uniform(84, 90, 200), np.round(rng.uniform(-90, 90, 200)), [90, -90, 90, 0]])
    lon = np.concatenate([rng.uniform(-180, 180, 600), np.round(rng.uniform(-180, 180, 200)), [0, 180, -180, 180]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "longitude double, latitude double").cache()
    at = list(range(0, 804, 80)) + [800, 801, 802, 803]
    want = [df.where(geo_distance(F.col("longitude"), F.col("latitude"), F.lit(float(lon[i])), F.lit(float(lat[i]))) <= km * 1000).count() for i in at]
    assert counts_within(lon[at], lat[at], lon, lat, km).tolist() == want


@pytest.mark.parametrize("name", ["j_radius", "j_radius_globe"])
def test_radius_queries_make_no_pairs(spark, name, capsys):
    registered()[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "CoGroupsInArrow" in plan and "SortMergeJoin" not in plan and " Inner" not in plan
