"""Streams that are left and taken up again: nothing is published twice, and sums go on where they stood."""

import datetime as dt

from castline.streaming.state import appended, capped, latest, publish_new
from pyspark.sql import functions as F


def _land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_contents_are_published_once_over_restarts(spark, tmp_path):
    log, out, marks = (str(tmp_path / n) for n in ("log", "out", "marks"))
    schema = "k long, v string"
    for rows, want in [([(1, "a"), (1, "a"), (2, None)], 2), ([(1, "a"), (2, None), (2, "")], 3), ([], 3), ([(3, "c"), (1, "a")], 4)]:
        got = publish_new(_land(spark, rows, schema, log), out, marks)
        assert got.count() == want == got.distinct().count()
    timed = "k long, at timestamp"
    log, out, marks = (str(tmp_path / n) for n in ("log2", "out2", "marks2"))
    day = lambda n: dt.datetime(2020, 1, n)
    for rows, want in [([(1, day(1)), (2, day(2))], 2), ([(1, day(1)), (3, day(3))], 3)]:
        assert publish_new(_land(spark, rows, timed, log), out, marks, "at", "5 days").count() == want


def test_the_last_row_of_a_key_counts(spark, tmp_path):
    log, out, marks = (str(tmp_path / n) for n in ("log", "out", "marks"))
    for rows, want in [([("a", 1), ("b", 2)], {"a": 1, "b": 2}), ([("a", 5)], {"a": 6, "b": 2})]:
        stream = _land(spark, rows, "k string, v long", log).groupBy("k").agg(F.sum("v").alias("total"))
        assert {r.k: r.total for r in latest(stream, ["k"], out, marks).collect()} == want


def test_caps_go_on_after_a_restart_and_days_are_forgotten(spark, tmp_path):
    log, out, marks = (str(tmp_path / n) for n in ("log", "out", "marks"))
    schema = "who string, call_id long, at timestamp, cost double"
    at = lambda d, h: dt.datetime(2020, 1, d, h)
    batches = [
        [("x", 2, at(1, 2), 6.0), ("x", 1, at(1, 1), 5.0), ("y", 3, at(1, 1), 20.0)], [("x", 4, at(1, 3), 1.0), ("y", 5, at(1, 9), 1.0), ("x", 6, at(2, 0), 9.0)],
        [("x", 7, at(20, 0), 1.0)], [("x", 8, at(2, 5), 1.0), ("x", 9, at(20, 1), 1.0)],
    ]
    for rows in batches:
        judged = capped(_land(spark, rows, schema, log), ["who"], 10.0)
        appended(judged, out, marks)
    got = {r.call_id: (r.spent, r.allowed) for r in spark.read.schema(judged.schema).parquet(out).collect()}
    print("GOT", got)
    assert got == {1: (0.0, True), 2: (5.0, True), 3: (0.0, True), 4: (11.0, False), 5: (20.0, False), 6: (0.0, True), 7: (0.0, True), 9: (1.0, True)}  # 8 is too late
