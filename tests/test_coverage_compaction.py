"""Coverage of slots degree by degree against brute force, and compaction that fails without harm."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from castline.operators import coverage
from castline.sinks import compaction

RECEIPT = "receipt_id string, month date, west long, south long, slot_version long, fetch_disposition string, stored_disposition string, r_start timestamp, r_end timestamp, r_west long, r_south long, r_width long, r_height long"
DAY = dt.timedelta(days=1)


def _covered(start, end, west, south, receipts):
    """Hour by hour, degree by degree."""
    for x in range(west, west + 10):
        for y in range(south, south + 10):
            at = start
            for r in sorted((r for r in receipts if r[9] <= x < r[9] + r[11] and r[10] <= y < r[10] + r[12]), key=lambda r: r[7]):
                if r[7] > at:
                    break
                at = max(at, r[8])
            if at < end:
                return False
    return True


def _random(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        month = dt.date(2020, rng.choice([1, 2, 3]), 1)
        west, south = rng.choice([20, 30]), rng.choice([-60, 0])
        start = dt.datetime(2020, month.month, 1) + rng.randint(-3, 20) * DAY
        rect = rng.choice([(west, south, 10, 10), (west - 5, south, 10, 10), (west + 5, south - 5, 8, 15), (west, south, 10, 5), (west, south + 5, 10, 5)])
        rows.append((f"r{i}", month, west, south, rng.choice([1, 2]), rng.choice(["fetched", coverage.ABSENT]), rng.choice(["stored", "empty_stored_cell", "empty_stored_cell", "empty_stored_domain" if i % 40 == 0 else "stored"]),
                     start, start + rng.choice([3, 12, 35]) * DAY, *rect))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_resolve_by_brute_force(spark, seed):
    rows = _random(seed)
    asked = (dt.datetime(2020, 1, 4, 12), dt.datetime(2020, 4, 1))
    request = spark.createDataFrame([asked], "request_start timestamp, request_end timestamp")
    tiles = [(w, s) for w in (20, 30, 40) for s in (-60, 0)]
    slots = coverage.request_slots(request, spark.createDataFrame(tiles, "west long, south long"))
    at = lambda m, d: dt.datetime(2020, m, d)
    members = [(dt.date(2020, 1, 1), 20, 0, at(1, 2)), (dt.date(2020, 2, 1), 20, 0, at(2, 2)), (dt.date(2020, 3, 1), 30, -60, at(3, 31)), (dt.date(2020, 2, 1), 40, 0, at(2, 9))]
    parts = [(dt.date(2020, 2, 1), 20, 0, "a"), (dt.date(2020, 2, 1), 20, 0, "b"), (dt.date(2020, 1, 1), 30, 0, "c")]
    versions = slots.select(*coverage.SLOT, F.lit(2).cast("long").alias("slot_version"))
    got = coverage.resolve(
        slots, spark.createDataFrame(rows, RECEIPT), versions, spark.createDataFrame(parts, "month date, west long, south long, part_id string"), spark.createDataFrame(members, "month date, west long, south long, at timestamp")
    ).collect()
    assert len(got) == 3 * 6
    for r in got:
        assert r.start == max(asked[0], dt.datetime(2020, r.month.month, 1)) and r.end == dt.datetime(2020, r.month.month + 1, 1)
        own = [x for x in rows if (x[1], x[2], x[3]) == (r.month, r.west, r.south) and x[7] < r.end and x[8] > r.start]
        every = [x for x in rows if (x[1], x[2], x[3]) == (r.month, r.west, r.south) and x[4] == 2]
        n = sum((m[0], m[1], m[2]) == (r.month, r.west, r.south) and r.start <= m[3] < r.end for m in members)
        held = sorted(p[3] for p in parts if p[:3] == (r.month, r.west, r.south))
        empties = [x for x in every if x[6].startswith("empty_stored_")]
        whole = [x for x in empties if x[6] == "empty_stored_domain"]
        gaps = [] if _covered(r.start, r.end, r.west, r.south, own) else ["fetch_coverage"]
        verified = []
        if n and not held:
            gaps.append("missing_active_generation")
        if not n:
            if whole or _covered(r.start, r.end, r.west, r.south, [x for x in empties if x in own]):
                verified = sorted(x[0] for x in (whole or empties))
            else:
                gaps.append("stored_empty_not_verified")
        absences = sorted(x[0] for x in every if x[5] == coverage.ABSENT) if n else []
        assert (r.n_members, r.gaps, r.parts, r.verified, r.absences) == (n, gaps, held if n else [], verified, absences), r
        assert r.state == (gaps[0] if gaps else "covered" if n else "empty_verified")
    states = {g for r in got for g in r.gaps}
    assert states == set(coverage.GAPS) and any(not r.gaps for r in got)


def _part(spark, rows):
    return spark.createDataFrame(rows, "slot string, profile_id string, level_index long, t double")


def test_compaction_swaps_or_leaves_the_version(spark, tmp_path):
    path = str(tmp_path / "store")
    first = _part(spark, [(s, p, i, float(i)) for s in ("a", "b", "c") for p in ("1", "2", "3") for i in range(4)])
    second = _part(spark, [("a", "1", 0, 9.0), ("b", "2", 0, 9.0), ("b", "2", 1, 8.0)])
    compaction.commit_part(first, path, 0)
    compaction.commit_part(second, path, 1)
    members = first.select("slot", "profile_id").distinct().where("NOT (slot = 'b' AND profile_id = '3')")
    schema, version = first.schema, compaction.current_version(spark, path)
    seen = lambda v=None: sorted(tuple(r)[:4] for r in compaction.newest(compaction.read_current(spark, path, schema, v)).select("slot", "profile_id", "level_index", "t").collect())
    old = seen()
    for damage in (lambda r: r.where("level_index > 0"), lambda r: r.withColumn("t", F.col("t") + (F.col("profile_id") == "2").cast("int")), lambda r: r.where("slot <> 'a'"), lambda r: r.unionByName(r.limit(1))):
        with pytest.raises(compaction.AuditError):
            compaction.compact(spark, path, schema, members, rewrite=damage)
        assert compaction.current_version(spark, path) == version and seen() == old
    told = {r.slot: (r.parts, r.n, r.profiles) for r in compaction.compact(spark, path, schema, members).collect()}
    assert told == {"a": (2, 9, 3), "b": (2, 6, 2)}
    assert seen() == [r for r in old if not (r[0] == "b" and r[1] == "3")] and seen(version) == old
    assert compaction.manifest(spark, path).groupBy("slot").count().where("count > 1").count() == 0
    assert compaction.compact(spark, path, schema, members).count() == 0 or compaction.current_version(spark, path) == version + 2
