"""What a batch publishes, on hand-made records."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from castline.catalogue import oracle_sql, queries
from castline.operators import publication as pub
from castline.operators.aggregate import ordered_totals


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_duplicates_differ_by_content_or_revision(spark):
    data = [("a", 2, "h", 1), ("a", 1, "h", 1), ("b", 1, "h", 1), ("b", 2, "h", 2), ("c", 5, None, None), ("d", 1, "h", None), ("d", 2, "h", 1), ("e", 1, None, None), ("e", 2, None, None)]
    got = pub.dedupe(spark.createDataFrame(data, "identity string, ordinal int, hash string, revision int"))
    assert rows(got, "identity", "n", "first", "outcome") == [("a", 2, 1, "identical_duplicate"), ("b", 2, 1, "conflict"), ("c", 1, 5, "single"), ("d", 2, 1, "conflict"), ("e", 2, 1, "identical_duplicate")]


def test_last_accepted_ignores_what_was_not_accepted(spark):
    data = [("c", "p", 1, "insert", "x"), ("c", "p", 3, "newer", "y"), ("c", "p", 4, "noop", "z"), ("d", "p", 9, "newer", "w"), ("c", "q", 1, "stale_skip", "x")]
    got = pub.last_accepted(spark.createDataFrame(data, "chunk string, profile_id string, ordinal int, outcome string, slot string"))
    assert rows(got, "chunk", "profile_id", "ordinal", "slot", "n") == [("c", "p", 3, "y", 2), ("d", "p", 9, "w", 1)]


MEMBER = "slot string, profile_id string, profile_hash string, levels long"


def test_manifests_of_changed_slots(spark):
    listed = spark.createDataFrame([("x", "a", "h", 1), ("x", "b", "h", 1), ("y", "c", "h", 1), ("z", "d", "h", 1)], MEMBER)
    accepted = spark.createDataFrame([("y", "a", "new", 2), ("y", "n", "new", 3)], MEMBER)
    made = pub.edited_manifest(listed, accepted)
    assert [tuple(r) for r in made.collect()] == [("x", "b", "h", 1, "kept"), ("y", "a", "new", 2, "added"), ("y", "c", "h", 1, "kept"), ("y", "n", "new", 3, "added")]
    assert pub.edited_manifest(listed, accepted.limit(0)).count() == 0


def test_written_parts_follow_each_other(spark):
    from castline.sources.readers import manifest_members

    members = spark.createDataFrame([("x", f"p{i:02}", f"h{i}", i) for i in (3, 1, 4, 0, 2)] + [("y", "q", "h", 7)], MEMBER)
    parts = {(r.slot, r.part): r for r in pub.manifest_parts(members, most=2).collect()}
    assert [[m.profile_id for m in parts["x", k].members] for k in range(3)] == [["p00", "p01"], ["p02", "p03"], ["p04"]]
    assert parts["x", 1].levels == 5 and parts["y", 0].n == 1
    assert rows(manifest_members(pub.manifest_parts(members, most=2)), "profile_id", "profile_hash") == rows(manifest_members(members), "profile_id", "profile_hash")


def test_newest_part_and_what_is_short(spark):
    data = [("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("a", 2, 0), ("b", 1, 0), ("u", 9, 0)]
    manifest = spark.createDataFrame([("x", "a", 2), ("x", "b", 1), ("y", "c", 1), ("z", "b", 2)], "slot string, k string, levels long")
    won = pub.newest_part(spark.createDataFrame(data, "k string, generation int, level int"), manifest, "k")
    assert rows(won, "k", "generation") == [("a", 2), ("a", 2), ("b", 1)]
    assert rows(pub.merge_check(won, manifest, "k"), "slot", "listed", "found", "levels_listed", "levels_found", "complete") == [("x", 2, 2, 3, 3, True), ("y", 1, 0, 1, 0, False), ("z", 1, 1, 2, 1, False)]


def test_latest_run_of_an_environment(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    runs = [("r1", "e", True, "complete", "normal", day(3), day(4)), ("r2", "e", True, "partial", "normal", day(3), day(5)), ("r3", "e", True, "complete", "historical", day(9), day(9)), ("r4", "e", False, "complete", "normal", day(8), day(8)),
            ("r5", "e", True, "failed", "normal", day(8), day(8)), ("r6", "h", True, "complete", "historical", day(1), day(1))]
    got = pub.latest_runs(
        spark.createDataFrame([("e",), ("h",), ("none",)], "environment_id string"), spark.createDataFrame(runs, "run_id string, environment_id string, closed boolean, state string, mode string, reference_time timestamp, created_at timestamp"),
        spark.createDataFrame([("r2", day(6)), ("r2", day(2)), ("r1", day(1))], "run_id string, retrieved_at timestamp"),
    )
    assert rows(got, "environment_id", "completed_runs", "latest_run_id", "ingested_at", "retrieved_from", "retrieved_to") == [("e", 3, "r2", day(5), day(2), day(6)), ("h", 1, None, None, None, None), ("none", 0, None, None, None, None)]


def test_requests_share_a_job_whatever_the_order_of_fields(spark):
    df = spark.createDataFrame([(1, 5, "p", None), (2, 4, "p", None), (3, 1, "p", "x"), (4, 1, None, "p")], "job_id int, created_at int, plan string, format string")
    assert rows(pub.group_requests(df, "plan", "format"), "request", "job", "attached") == rows(pub.group_requests(df, "format", "plan"), "request", "job", "attached")
    assert sorted(r[1:] for r in rows(pub.group_requests(df, "plan", "format"), "request", "job", "attached")) == [(2, 2), (3, 1), (4, 1)]


def test_three_sets(spark):
    of = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert rows(pub.sets_equal(of(1, 2, 2, None), of(2, 1, None), of(None, 1, 2)), "n_before", "n_data", "n_common", "equal") == [(3, 3, 3, True)]
    assert rows(pub.sets_equal(of(1, 2), of(2), of(1, 2)), "n_common", "equal") == [(1, False)]
    assert rows(pub.sets_equal(of(), of(), of()), "n_common", "equal") == [(0, True)]


# Added one after the other these end below a half; as two sums of three, or from the last on, at a half.
PRICES = [328396.97, 20025.57, 262598.17, 291426.97, 408646.64, 2416.18]


def test_merged_totals_equal_sql_over_several_parts(spark, tmp_path):
    (tmp_path / "orders.parquet").mkdir()
    for part in range(2):
        ids = range(3 * part, 3 * part + 3)
        made = {"o_orderkey": list(ids), "o_custkey": [1] * 3, "o_orderstatus": ["F"] * 3, "o_totalprice": [PRICES[i] for i in ids], "o_orderdate": [dt.datetime(1996, 1, 1)] * 3, "o_orderpriority": ["x"] * 3}
        pq.write_table(pa.table(made), tmp_path / "orders.parquet" / f"part-{part}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # rows are added as they stand
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    got = queries()["ing_merge"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(oracle_sql()["ing_merge"]).fetchall() == [(1, "keep", 5, 1313510)]


def test_totals_follow_the_order_given(spark):
    rows_ = [(1, i, p) for i, p in enumerate(PRICES)] + [(1, 9, None), (2, 0, None), (None, 2, 0.25), (None, 2, 0.25)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows_[::-1], "k int, at int, x double").repartition(parts)
        got = {r.k: (r.n, r.total) for r in ordered_totals(df, "k", "x", "at").collect()}
        assert got == {1: (7, 1313510.4999999998), 2: (1, None), None: (2, 0.5)}
