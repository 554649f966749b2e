"""Results made safe, their summaries and bounds, tallies, traits, scores of outcomes and names of files, on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from castline.functions.text import file_parts
from castline.operators import evaluation, results


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_numbers_that_are_not_finite_are_null_and_counted(spark):
    df = spark.createDataFrame([(1, math.nan, "a"), (2, math.inf, None), (3, None, ""), (4, 1.5, "b")], "i int, x double, s string")
    kinds = {"i": "integer", "x": "number", "s": "string"}
    clean, audit = results.sanitize(df, kinds, most_rows=4)
    assert rows(clean, "i", "x") == [(1, None), (2, None), (3, None), (4, 1.5)]
    assert tuple(audit.first()) == (4, 2, 0, 0, None)
    assert results.sanitize(df, kinds, most_rows=3)[1].first().verdict == "result_too_large"
    assert tuple(results.sanitize(df.limit(0), kinds, 1)[1].first()) == (0, 0, 0, 0, None)


@pytest.mark.parametrize("text, verdict", [("x" * 512, None), ("x" * 513, "internal_error"), ("see S3://bucket", "internal_error"), ("selected", None), ("SELECT 1", "internal_error"), ("Traceback (most", "internal_error"), ("inserted", None)])
def test_texts_that_may_not_leave(spark, text, verdict):
    assert results.sanitize(spark.createDataFrame([(text,), (None,)], "s string"), {"s": "string"}, 10)[1].first().verdict == verdict


@pytest.mark.parametrize("columns", [{"i": "string", "x": "number"}, {"i": "integer", "x": "integer"}, {"x": "number", "i": "integer"}, {"i": "integer"}, {"i": "boolean", "x": "number"}])
def test_names_and_types_are_held(spark, columns):
    with pytest.raises(ValueError):
        results.sanitize(spark.createDataFrame([(1, 2.0)], "i int, x double"), columns, 1)


def test_summary_of_numeric_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, None), ("b", 3, None, None)], "s string, i int, x double, d decimal(9,2)")
    assert rows(results.summarize(df), "column", "lo", "hi", "mean", "n") == [("d", None, None, None, 0), ("i", 1.0, 3.0, 2.0, 2), ("x", 2.0, 2.0, 2.0, 1)]
    assert [r.s for r in results.first_rows(df, "s", n=1).collect()] == ["a"]


def test_series_and_their_bounds(spark):
    df = spark.createDataFrame([("m1", "A", 1.0, 5), ("m2", "A", None, 6), ("m1", "B", 2.0, 7)], "x string, k string, t double, n int")
    points = results.series_points(df, "x", "k", ("t", "n"))
    assert points.count() == 6 and ("t", "A", "m2", None) in rows(points, "metric", "series", "x", "y")
    assert tuple(results.series_bounds(points, 2, 4).first()) == (4, 2, None)
    assert results.series_bounds(points, 1, 4).first().verdict == results.series_bounds(points, 2, 3).first().verdict == "result_too_large"
    assert tuple(results.series_bounds(points.limit(0), 1, 1).first()) == (0, 0, None)
    assert results.series_bounds(results.series_points(df, "x", None, ("t",)), 3, 1).first().verdict is None


def test_depth_of_leaves_and_overall(spark):
    df = spark.createDataFrame([("a", 4), ("a", None), (None, 2)], "k string, levels long")
    assert rows(results.level_depth_stats(df, "k"), "k", "overall", "profiles", "unknown", "levels", "mean", "least", "most") == sorted([
        ("a", False, 2, 1, 4, 4.0, 4, 4), (None, False, 1, 0, 2, 2.0, 2, 2), (None, True, 3, 1, 6, 3.0, 2, 4)], key=repr)


def test_tally_counts_kept_values_modes_and_codes(spark):
    columns = [f"{v}{x}" for v in ("pressure", "temperature", "salinity") for x in ("", "_adjusted", "_qc", "_adjusted_qc", "_data_mode")]
    schema = ", ".join(f"{c} {'string' if c.endswith(('_qc', '_mode')) else 'double'}" for c in columns)
    real, delayed, none = (1.0, None, "1", None, "R"), (None, 2.0, None, "4", "D"), (None,) * 5
    df = spark.createDataFrame([real + delayed + none, real + real + none], schema)
    got = rows(results.qc_mode_tally(df, "science_ready"), "variable", "kind", "code", "n")
    assert got == sorted([("pressure", "kept", None, 2), ("pressure", "mode", "R", 2), ("pressure", "qc", "1", 2), ("temperature", "kept", None, 1), ("temperature", "mode", "D", 1), ("temperature", "mode", "R", 1), ("temperature", "qc", "4", 1), ("temperature", "qc", "1", 1)], key=repr)


def test_traits_and_gaps(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", None)], "id string, v int")
    got = results.witness_matrix(df, "id", {"one": F.col("v") == 1, "two": F.col("v") == 2})
    assert rows(got, "trait", "witnesses", "first", "gap") == [("one", 2, "a", False), ("two", 0, None, True)]


def test_outcomes_by_the_rules(spark):
    gold = [(1, "plan", False, None), (2, "plan", False, None), (3, "plan", False, None), (4, "plan", False, None), (5, "plan", False, None), (6, "clarify", True, ["a", "b"]), (7, "clarify", True, ["a"]), (8, "unsupported", False, None), (9, "unsupported", False, None), (10, "plan", False, None)]
    said = [(1, "plan", None, False, "m", "x"), (2, "plan", None, False, "m", "y"), (3, "clarify", ["a"], True, None, None), (4, "clarify", ["a"], False, None, None), (5, "unsupported", None, False, None, None), (6, "clarify", ["b", "a", "a"], False, None, None),
            (7, "plan", None, False, "m", "x"), (8, "clarify", ["a"], False, None, None), (9, "plan", None, False, "m", "x")]
    items = spark.createDataFrame([(i, "c1" if i < 6 else "c2", k, a, m, "m", "x") for i, k, a, m in gold], "id int, category string, kind string, ambiguous boolean, missing array<string>, op string, place string")
    outcomes = spark.createDataFrame([(*s, 10) for s in said], "id int, kind string, missing array<string>, invalid boolean, op string, place string, tokens long")
    made = evaluation.score_outcomes(items, outcomes, ["op", "place"])
    assert [(r.id, r.exact, r.failure) for r in made.orderBy("id").collect()] == [
        (1, True, None), (2, False, "wrong_place"), (3, False, "invalid_plan"), (4, False, "unnecessary_clarification"), (5, False, "unsupported_mismatch"), (6, None, None), (7, None, "missing_clarification"),
        (8, None, "unnecessary_clarification"), (9, None, "unsupported_mismatch"), (10, False, "provider_error"),
    ]
    assert rows(made.where("gold_kind = 'clarify'"), "id", "missing_match", "clarification_appropriate") == [(6, True, True), (7, False, False)]
    overall = evaluation.summary(made, ["op", "place"]).where("overall").first()
    assert (overall["items"], overall.plan_items, overall.kind_accuracy, overall.plan_exact_match, overall.op, overall.tokens_per_query) == (10, 6, 0.3, pytest.approx(1 / 6), pytest.approx(2 / 6), 9.0)
    assert dict(rows(evaluation.failure_counts(made), "failure", "n"))["unsupported_mismatch"] == 2


@pytest.mark.parametrize("name, want", [("dac/aoml/13857/profiles/R13857_001.nc", ("13857", 1, "A", "gdac:13857_1A")), ("BD2900123_0123D.nc", ("2900123", 123, "D", "gdac:2900123_123D")), ("R13857_01.nc", None), ("R13857_001_traj.nc", None), ("r13857_001.nc", None), ("", None), (None, None)])
def test_names_of_profile_files(spark, name, want):
    got = spark.createDataFrame([(name,)], "n string").select(file_parts(F.col("n")).alias("f")).first().f
    assert (got and tuple(got)) == want
