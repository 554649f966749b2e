"""Hand-made cases: the golden four-profile table, the QC truth table, distances, tiles, edges."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from castline.functions.geo import geo_distance, tile_key
from castline.functions.qc import qc_value
from castline.operators.aggregate import aggregate, depth_bin
from castline.operators import sarima
from castline.queries.ingest import revision_outcome
from castline.queries.selection import in_regions, page

GOLDEN = [("P1", "R", 5, 20, 35, "1"), ("P1", "R", 50, 18, 35.2, "2"), ("P1", "R", 500, 5, 34.8, "4"),
          ("P2", "D", 5, 22, 35.1, "1"), ("P2", "D", 60, 21, 35.3, "1"), ("P2", "D", 400, 19, 34.9, "1")]


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for pid, mode, p, t, s, qc in GOLDEN:
        row = {"profile_id": pid}
        for v, x, c in (("pressure", p, "1"), ("temperature", t, qc), ("salinity", s, "1")):
            own, other = ("", "_adjusted") if mode == "R" else ("_adjusted", "")
            row |= {v + own: float(x), v + other: None, f"{v}{own}_qc": c, f"{v}{other}_qc": None, f"{v}_data_mode": mode}
        rows.append(row)
    types = {c: "double" if c in ("pressure", "temperature", "salinity") or c.endswith("adjusted") else "string" for c in rows[0]}
    schema = ", ".join(f"{c} {k}" for c, k in types.items())
    return spark.createDataFrame([tuple(r[c] for c in types) for r in rows], schema)


def _aggregate(golden, unit, policy="science_ready", metrics=("mean", "count")):
    rows = golden.select("profile_id", qc_value("pressure", policy).alias("p"), qc_value("temperature", policy).alias("t"))
    return aggregate(rows, [F.lit("all").alias("k")], ["k"], {"t": F.col("t")}, metrics, unit).first()


def test_golden_units(golden):
    m, p = _aggregate(golden, "measurement"), _aggregate(golden, "profile")
    assert (m.t_mean, m.t_count) == (20.0, 5)
    assert p.t_mean == pytest.approx((19 + 62 / 3) / 2) and p.t_count == 2
    assert _aggregate(golden, "measurement", "mode_selected").t_mean == pytest.approx((20 + 18 + 5 + 22 + 21 + 19) / 6)


def test_golden_bins_keep_empty_groups(golden):
    rows = golden.select("profile_id", qc_value("pressure", "science_ready").alias("p"), qc_value("temperature", "science_ready").alias("t"))
    got = aggregate(rows, [depth_bin(F.col("p"), 50).alias("bin")], ["bin"], {"t": F.col("t")}, ("mean", "count"), "measurement").orderBy("bin").collect()
    assert [tuple(r) for r in got] == [(0.0, 21.0, 2), (50.0, 19.5, 2), (400.0, 19.0, 1), (500.0, None, 0)]


def test_qc_truth_table(spark):
    cases = [(m, q, q) for m, q in itertools.product(["R", "A", "D", None, "", "X", "r"], ["1", "2", "3", "4", "9", None])]
    df = spark.createDataFrame([(m, a, b, 1.0, 2.0) for m, a, b in cases], "temperature_data_mode string, temperature_qc string, temperature_adjusted_qc string, temperature double, temperature_adjusted double")
    got = df.select("temperature_data_mode", "temperature_qc", qc_value("temperature", "science_ready").alias("s"), qc_value("temperature", "mode_selected").alias("m")).collect()
    for mode, qc, s, m in got:
        base = {"R": 1.0, "A": 2.0, "D": 2.0}.get(mode)
        assert m == base and s == (base if qc in ("1", "2") else None)
    with pytest.raises(ValueError):
        qc_value("temperature", "best")


def test_distance_against_sphere_and_itself(spark):
    df = spark.createDataFrame([(20.0, 0.0, 20.0, 0.0), (20.0, 0.0, 21.0, 0.0), (30.0, 20.0, 35.0, 25.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo_distance(*[F.col(x) for x in "abcd"])).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(111319.49, abs=1)
    h = math.sin(math.radians(2.5)) ** 2 + math.cos(math.radians(20)) * math.cos(math.radians(25)) * math.sin(math.radians(2.5)) ** 2
    assert got[2] == pytest.approx(2 * 6371008.8 * math.asin(math.sqrt(h)), rel=0.006)


def test_tiles_own_the_outer_edges(spark):
    df = spark.createDataFrame([(120.0, 30.0), (20.0, -60.0), (29.999, -50.0), (30.0, 29.999)], "x double, y double")
    assert [r[0] for r in df.select(tile_key(F.col("x"), F.col("y"))).collect()] == ["110_20", "20_-60", "20_-50", "30_20"]


def test_region_edges_vertices_and_holes(spark):
    ring = lambda pts: [("r", *map(float, a), *map(float, b)) for a, b in zip(pts, [*pts[1:], pts[0]], strict=True)]
    edges = spark.createDataFrame(ring([(0, 0), (10, 0), (10, 10), (0, 10)]) + ring([(4, 4), (6, 4), (6, 6), (4, 6)]), "region string, x1 double, y1 double, x2 double, y2 double")
    pts = {"inside": (2, 2), "hole": (5, 5), "vertex": (0, 0), "edge": (10, 5), "hole_edge": (4, 5), "out": (11, 5), "level": (-1, 10)}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in pts.items()], "profile_id string, longitude double, latitude double")
    assert {r[0] for r in in_regions(df, edges).collect()} == {"inside", "vertex", "edge", "hole_edge"}


def test_page_is_strict_after_the_key(spark):
    df = spark.createDataFrame([("a", "2020-01-01"), ("b", "2020-01-01"), ("c", "2020-01-02")], "profile_id string, d string").select("profile_id", F.col("d").cast("timestamp").alias("observed_at"))
    assert [r[0] for r in page(df, 1).collect()] == ["c", "b"]
    assert [r[0] for r in page(df, 5, ("2020-01-01", "b")).collect()] == ["a"]


@pytest.mark.parametrize(("sh", "nh", "stored", "new", "want"), [
    (None, "a", None, None, "insert"), ("a", "a", None, None, "noop"), ("a", "b", None, None, "revision_conflict"), ("a", "a", {"c": 1}, {"c": 1}, "noop"),
    ("a", "a", {"c": 1}, {"c": 2}, "revision_only"), ("a", "b", {"c": 1}, {"c": 2}, "newer"), ("a", "b", {"c": 2}, {"c": 1}, "stale_skip"),
    ("a", "a", {"c": 1, "d": 2}, {"c": 2, "d": 1}, "unordered_noop"), ("a", "b", {"c": 1}, {"d": 1}, "revision_conflict"), ("a", "a", {"c": 1}, None, "unordered_noop"),
])
def test_revision_outcomes(spark, sh, nh, stored, new, want):
    df = spark.createDataFrame([(sh, nh, stored, new)], "sh string, nh string, s map<string,long>, n map<string,long>")
    assert df.select(revision_outcome(F.col("sh"), F.col("nh"), F.col("s"), F.col("n"))).first()[0] == want


def test_fit_prefers_the_order_that_made_the_series():
    rng, y = np.random.default_rng(1), np.zeros(120)
    for i in range(1, 120):
        y[i] = 0.8 * y[i - 1] + rng.normal()
    score = {}
    for order in ((1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0)):
        _, e, sizes = sarima.fit([y], order)
        score[order] = sarima.aicc(e[0], int(sizes[0]), sarima.parameters(order))
    assert score[1, 0, 0, 0, 0, 0] < score[0, 0, 0, 0, 0, 0]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


# Plans -------------------------------------------------------------------------------------------


def test_a_plan_lists_every_violation_together():
    from castline.plans import document

    good = {"time_range": {"start": "2025-01-01T00:00:00Z", "end": "2025-02-01T00:00:00Z"}, "geography": {"kind": "bbox", "west": 40, "south": -10, "east": 60, "north": 10},
            "variables": ["salinity", "temperature", "salinity"], "operation": {"kind": "aggregate", "metrics": ["mean"], "group_by": ["month"]}}
    assert document.violations(good) == []
    assert document.canonical(good)["variables"] == ["temperature", "salinity"] and document.canonical(good)["operation"]["unit"] == "profile"
    same = good | {"time_range": {"start": "2025-01-01T05:30:00+05:30", "end": "2025-02-01T00:00:00+00:00"}, "variables": ["temperature", "salinity"], "qc_policy": "science_ready", "presentation": {"kind": "table"}}
    assert document.plan_sha256(good) == document.plan_sha256(same) != document.plan_sha256(good | {"qc_policy": "mode_selected"})
    bad = good | {"geography": {"kind": "bbox", "west": 40, "south": 10, "east": 40, "north": 10}, "depth_dbar": {"min": 50, "max": 20}, "qc_policy": "raw", "presentation": {"kind": "map", "bins": 5},
                  "operation": {"kind": "aggregate", "metrics": ["mean", "mean"], "group_by": ["depth_bin", "depth_bin"]}}
    assert sorted(document.violations(bad)) == sorted([
        ("depth_dbar", "invalid_depth_range"), ("geography", "invalid_geography"), ("geography", "invalid_geography"), ("qc_policy", "operation_variable_mismatch"), ("presentation.kind", "operation_variable_mismatch"),
        ("presentation.bins", "invalid_value"), ("operation.metrics", "invalid_value"), ("operation.group_by", "invalid_value"), ("operation.depth_bin_size", "invalid_value"),
    ])
    form = document.violations({"variables": ["oxygen"], "geography": {"kind": "circle"}, "operation": {"kind": "aggregate", "metrics": ["mode"]}, "sql": "drop"})
    assert set(form) == {("sql", "unknown_field"), ("variables", "unknown_variable"), ("time_range", "missing_field"), ("geography", "invalid_value"), ("operation.metrics", "unknown_function")}
    assert document.violations(good | {"time_range": {"start": "2025-01-01T00:00:00", "end": "2025-02-01T00:00:00Z"}}) == [("time_range.start", "invalid_time_range")]
    with pytest.raises(document.PlanError):
        document.plan_sha256(bad)


def test_tiles_of_a_triangle_and_of_a_region_within_a_tile(spark):
    from castline.operators.regions import region_tiles

    ring = lambda name, pts: [(name, *map(float, a), *map(float, b)) for a, b in zip(pts, [*pts[1:], pts[0]], strict=True)]
    edges = ring("tri", [(0, 0), (30, 0), (0, 30)]) + ring("small", [(42, 2), (44, 2), (43, 5)]) + ring("wide", [(60, 0), (100, 0), (100, 30), (60, 30)])
    got = {tuple(r) for r in region_tiles(spark.createDataFrame(edges, "region string, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert {x for x in got if x[0] == "small"} == {("small", 40, 0)}
    assert ("wide", 80, 10) in got and ("tri", 10, 10) in got and ("tri", 20, 20) not in got and ("tri", 20, 10) in got


@pytest.mark.parametrize("accuracy", [4, 10_000])
def test_quantiles_of_groups_against_sorted_values(spark, monkeypatch, accuracy):
    """Also where the brackets are wide, with ties, nulls and a null key."""
    from castline.operators import quantiles as q

    monkeypatch.setattr(q, "ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 300).astype(float), "c": np.array([7.0]), None: rng.normal(size=40)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    wanted = {"m": ("linear", 0.5), "q": ("linear", 0.95), "n": ("nearest", 0.8), "i": ("index", 0.9)}
    got = {r.k: r for r in q.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s, n = np.sort(vs), len(vs)
        assert got[k].m == pytest.approx(np.quantile(s, 0.5)) and got[k].q == pytest.approx(np.quantile(s, 0.95))
        assert got[k].n == s[max(0, math.ceil(n * 0.8) - 1)] and got[k].i == s[round(0.9 * (n - 1))]
