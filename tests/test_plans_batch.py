"""A table of plans and single plans: the same rules broken, the same digest."""

import datetime as dt
import random

from pyspark.sql import functions as F

from castline.plans import document

SCHEMA = (
    "start timestamp, end timestamp, depth_min double, depth_max double, south double, north double, west double, east double, geo_km double, qc_policy string, kind string, presentation string, variables array<string>, bins int, limit_ int, "
    "radius_km double, k int, metrics array<string>, group_by array<string>, depth_bin_size int, geography string, region string, geo_longitude double, geo_latitude double, longitude double, latitude double, cursor string, unit string"
)


def _plan(rng):
    pick = rng.choice
    start = dt.datetime(2020, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=rng.randint(0, 9000), microseconds=pick([0, 0, 500]))
    end = start + dt.timedelta(days=pick([-1, 0, 5, 31, 32, 366, 367]), seconds=pick([0, 1]))
    plan = {"time_range": {"start": start.astimezone(dt.timezone(dt.timedelta(hours=pick([0, 5])))).isoformat(), "end": end.isoformat()}, "variables": rng.sample(document.VARIABLES, rng.randint(1, 3)), "presentation": {"kind": pick(document.PRESENTATIONS)}}
    plan["geography"] = pick([
        {"kind": "bbox", "west": pick([10, 40.5]), "south": pick([-5, 5]), "east": pick([10, 80]), "north": pick([-5, 20.25])}, {"kind": "named_region", "value": "Arabian Sea"},
        {"kind": "point_radius", "longitude": 60, "latitude": 5.5, "radius_km": pick([100, 2000.0, 2001])},
    ])
    plan["operation"] = pick([
        {"kind": "profiles"} | pick([{}, {"limit": pick([1, 1000, 1001])}]) | pick([{}, {"cursor": "a|b"}]), {"kind": "nearest", "longitude": 1, "latitude": 2.5, "radius_km": pick([5, 2500])} | pick([{}, {"k": pick([1, 101])}]),
        {"kind": "aggregate", "metrics": pick([[], ["mean"], ["mean", "mean"], ["count", "max"]])} | pick([{}, {"group_by": rng.choices(document.GROUP_KEYS, k=rng.randint(0, 3))}]) | pick([{}, {"depth_bin_size": 50}]) | pick([{}, {"unit": "measurement"}]),
    ])
    for k, v in (("depth_dbar", pick([{"max": 100}, {"min": 100, "max": 100.0}, {"min": 5, "max": 700}])), ("qc_policy", pick(document.QC_POLICIES))):
        if rng.random() < 0.6:
            plan[k] = v
    if rng.random() < 0.3:
        plan["presentation"]["bins"] = pick([1, 200, 201])
    return plan


def _row(plan):
    p, wrong = document._read(plan)
    assert not wrong, wrong
    f = document.rule_fields(p)
    geo, op = p["geography"], p["operation"]
    at = lambda k: dt.datetime.fromisoformat(p["time_range"][k]).astimezone(dt.UTC).replace(tzinfo=None)
    f |= {"start": at("start"), "end": at("end"), "geography": geo["kind"], "region": geo.get("value"), "geo_longitude": geo.get("longitude"), "geo_latitude": geo.get("latitude"), "longitude": op.get("longitude"), "latitude": op.get("latitude"), "cursor": op.get("cursor"), "unit": op.get("unit")}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    return tuple(float(f[c]) if kinds[c] == "double" and f[c] is not None else f[c] for c in names)


def test_both_forms_agree_on_random_plans(spark):
    rng = random.Random(9)
    plans = [_plan(rng) for _ in range(400)]
    df = spark.createDataFrame([_row(p) for p in plans], SCHEMA)
    got = df.select(document.codes().alias("codes"), F.sha2(document.plan_text(), 256).alias("sha")).collect()
    clean = 0
    for plan, r in zip(plans, got, strict=True):
        wrong = document.violations(plan)
        assert r.codes == [f"{path}:{code}" for path, code in wrong], plan
        if not wrong:
            clean += 1
            assert r.sha == document.plan_sha256(plan), plan
    assert clean > 5 and len({c for r in got for c in r.codes}) >= 14


def test_plans_that_differ_in_place_or_metric_differ_in_digest():
    base = {"time_range": {"start": "2020-01-01T00:00:00Z", "end": "2020-01-20T00:00:00Z"}, "geography": {"kind": "bbox", "west": 1, "south": 2, "east": 3, "north": 4}, "variables": ["salinity"], "operation": {"kind": "aggregate", "metrics": ["mean"], "group_by": ["month"]}}
    other = [base | {"geography": base["geography"] | {"west": 1.5}}, base | {"operation": base["operation"] | {"metrics": ["max"]}}, base | {"geography": base["geography"] | {"west": 1.0}}]
    first, place, metric, same = (document.plan_sha256(p) for p in (base, *other))
    assert len({first, place, metric}) == 3 and same == first
