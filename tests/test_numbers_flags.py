"""Exact numbers against decimal arithmetic, and the flags of levels by hand."""

import random
from decimal import Decimal

from castline.functions.numeric import exact_numbers
from castline.operators.flags import level_flags
from castline.operators.reporting import map_clusters, reconcile


def _want(text):
    if text is None:
        return None, None, None
    try:
        token = Decimal(text)
    except ArithmeticError:
        return None, "not_a_number", None
    if not token.is_finite():
        return None, "not_a_number", None
    value = float(token)
    if abs(value) == float("inf"):
        return None, "float64_overflow", None
    if token != 0 and value == 0:
        return None, "float64_underflow", None
    flags = ["rounded"] if Decimal.from_float(value) != token else []
    if value != 0 and abs(value) < 2.0**-1022:
        flags.append("subnormal")
    return (value if token != 0 else 0.0), None, flags


def test_numbers_by_decimal_arithmetic(spark):
    rng = random.Random(1)
    texts = [None, "", ".", "x", "NaN", "1f", "0", "-0", "0e5", "+1.50", "00012.500", "0.1", "0.5", "17.3", "1e-400", "1e400", "-1e400", "1e308", "1.7976931348623157e308", "1.7976931348623159e308", "4.9e-324", "2.4e-324", "5e-324",
             "2.2250738585072014e-308", "2.2250738585072011e-308", "9007199254740993", "9007199254740992", "1e22", "1e23", "100000000000000000000000", "123456789012345678901234567890", "1267650600228229401496703205376", "5.", ".25", "1E3", "1e+2"]
    texts += [str(Decimal.from_float(x)) for x in (0.1, 1 / 3, 2.0**-1074, 2.0**-1022, 1.1e300, -7.3e-200)] + [str(Decimal.from_float(0.1)) + "1"]
    texts += [f"{rng.choice(['', '-', '+'])}{rng.randint(0, 10 ** rng.randint(0, 25))}.{rng.randint(0, 10 ** rng.randint(0, 25))}e{rng.randint(-330, 310)}" for _ in range(200)]
    texts += [repr(rng.uniform(-1e5, 1e5)) for _ in range(30)] + [str(rng.randint(-999, 999) / 8) for _ in range(30)]
    got = exact_numbers(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").orderBy("i").collect()
    for r, text in zip(got, texts, strict=True):
        assert (r.value, r.reject, r["flags"]) == _want(text), text
    assert str([r.value for r in got if r.text == "-0"][0]) == "0.0"


def test_flags_of_levels(spark):
    names = [f"{v}_{c}" for v in ("pressure", "temperature", "salinity") for c in ("text", "code", "present")]
    schema = "profile_id string, level_index int, " + ", ".join(f"{n} {'boolean' if n.endswith('present') else 'string'}" for n in names)
    rows = [
        ("a", 0, "5.5", "1", True, "60", "x", True, None, None, False), ("a", 1, None, "", True, "0.1", "1", True, None, None, False), ("a", 2, "4", "9", True, "1e-310", "", True, None, None, False),
        ("a", 3, "5.50", "1", True, None, None, True, None, None, False), ("a", 4, "12000.5", "12", True, "1e999", "1", True, None, None, False), ("b", 0, "5.5", "1", True, "1", "1", True, "51.5", "1", True),
    ]
    got = {(r.profile_id, r.level_index): (r.pressure_flags, r.temperature_flags, r.salinity_flags) for r in level_flags(spark.createDataFrame(rows, schema)).collect()}
    absent = ["variable_absent"]
    assert got == {
        ("a", 0): ([], ["qc_unknown", "outside_plausibility_range"], absent), ("a", 1): ([], ["rounded"], absent), ("a", 2): (["nonmonotonic_pressure"], ["rounded", "subnormal"], absent),
        ("a", 3): (["repeated_pressure"], [], absent), ("a", 4): (["qc_unknown", "outside_plausibility_range"], [], absent), ("b", 0): ([], [], ["outside_plausibility_range"]),
    }


def test_reconciliation_changes_one_digest(spark):
    rows = [(str(i), f"h{i}", i, "2020-01-01" if i < 5 else "2021-01-01") for i in range(10)]
    stored = spark.createDataFrame(rows, "profile_id string, hash string, levels long, observed_at string")
    members = lambda change: spark.createDataFrame([(p, change.get(p, h), n) for p, h, n, _ in rows], "profile_id string, hash string, levels long")
    told = lambda m: {r.scope: r for r in reconcile(stored, m, "2020-01-01", "2020-12-31").collect()}
    same = told(members({}))
    assert all(r.balanced for r in same.values()) and same["run_eligible_stored"].profiles == 5
    late = told(members({"7": "other"}))
    assert [s for s in same if same[s].digest != late[s].digest] == ["full_snapshot"] and not late["full_stored"].balanced and late["run_eligible_snapshot"].balanced
    none = told(members({}).where("false"))
    assert (none["full_snapshot"].profiles, none["full_snapshot"].levels, none["full_snapshot"].balanced) == (0, 0, False)


def test_clusters_of_every_zoom_hold_all_points(spark):
    points = spark.range(500).selectExpr("(id * 7919 % 36000) / 100.0 - 180 AS longitude", "(id * 104729 % 18000) / 100.0 - 90 AS latitude")
    got = map_clusters(points).groupBy("zoom").sum("n").collect()
    assert {(r.zoom, r["sum(n)"]) for r in got} == {(z, 500) for z in range(8)}
