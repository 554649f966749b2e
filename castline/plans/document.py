"""Query plans as documents: checked, named by a digest, run as one lazy DataFrame, and accounted for.

A plan is a dict with ``time_range``, ``geography``, ``variables`` and ``operation``, and optionally
``dataset``, ``depth_dbar``, ``qc_policy`` and ``presentation``. ``violations`` lists everything that is wrong
with one. ``run_plan`` puts the library's operators together; Catalyst does the rest. ``codes`` is the rule list
for a table of plans.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castline.functions.geo import box_tile_keys, geo_distance, in_bbox, within_km
from castline.functions.qc import qc_value, raw_columns
from castline.operators import aggregate as agg
from castline.operators.regions import in_regions
from castline.sources.store import SLOT

# What a plan may say, and the limits of a request.
VARIABLES = ("temperature", "salinity", "pressure")
QC_POLICIES = ("science_ready", "mode_selected", "raw")
METRICS = ("mean", "count", "min", "max", "stddev", "median")
GROUP_KEYS = ("month", "day", "profile", "float", "depth_bin", "region")
DEPTH_BIN_SIZES = (10, 25, 50, 100)
PRESENTATIONS = ("table", "line_chart", "scatter", "profile_plot", "ts_diagram", "histogram", "map")
UNITS = ("profile", "measurement")
PLAN_SCHEMA, MAX_DEPTH_DBAR = "stage2-plan-v1", 12000.0
LIMITS = {"time_span_days": 366, "page_size": 1000, "nearest_radius_km": 2000.0, "nearest_k": 100, "histogram_bins": 200}


class PlanError(ValueError):
    """A plan that breaks rules; ``details`` holds (path, code) of each."""

    def __init__(self, details: list[tuple[str, str]]):
        super().__init__("; ".join(f"{path}: {code}" for path, code in details))
        self.details = details


def _number(low: float, high: float, open_low: bool = False):
    ok = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and (low < v if open_low else low <= v) and v <= high
    return ok


_WHOLE = lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 1
_LON, _LAT, _KM = _number(-180, 180), _number(-90, 90), _number(0, float("inf"), True)
_ONE_OF = lambda *names: lambda v: v in names
_EACH_OF = lambda names: lambda v: isinstance(v, (list, tuple)) and all(x in names for x in v)


def _instant(v: Any) -> bool:
    try:
        return datetime.fromisoformat(v).tzinfo is not None
    except (TypeError, ValueError):
        return False


# field: (required, default, test, code when the test fails)
_GEOGRAPHY = {
    "named_region": {"value": (True, None, lambda v: isinstance(v, str) and 1 <= len(v) <= 128, "invalid_geography")},
    "bbox": {k: (True, None, _LON if k in ("west", "east") else _LAT, "invalid_geography") for k in ("west", "south", "east", "north")},
    "point_radius": {"longitude": (True, None, _LON, "invalid_geography"), "latitude": (True, None, _LAT, "invalid_geography"), "radius_km": (True, None, _KM, "invalid_geography")},
}
_OPERATION = {
    "profiles": {"limit": (False, None, _WHOLE, "invalid_value"), "cursor": (False, None, lambda v: isinstance(v, str) and len(v) <= 512, "invalid_value")},
    "aggregate": {
        "group_by": (False, [], _EACH_OF(GROUP_KEYS), "unknown_function"), "metrics": (True, None, _EACH_OF(METRICS), "unknown_function"),
        "unit": (False, "profile", _ONE_OF(*UNITS), "invalid_value"), "depth_bin_size": (False, None, _ONE_OF(*DEPTH_BIN_SIZES), "invalid_value"),
    },
    "nearest": {
        "longitude": (True, None, _LON, "invalid_value"), "latitude": (True, None, _LAT, "invalid_value"), "radius_km": (True, None, _KM, "invalid_value"), "k": (False, 10, _WHOLE, "invalid_value"),
    },
}
_TIME = {k: (True, None, _instant, "invalid_time_range") for k in ("start", "end")}
_DEPTH = {"min": (False, 0.0, _number(0, MAX_DEPTH_DBAR), "invalid_depth_range"), "max": (True, None, _number(0, MAX_DEPTH_DBAR, True), "invalid_depth_range")}
_PRESENTATION = {"kind": (False, "table", _ONE_OF(*PRESENTATIONS), "disallowed_format"), "bins": (False, None, _WHOLE, "invalid_value")}
_TOP = {
    "dataset": (False, "core", _ONE_OF("core"), "invalid_value"), "qc_policy": (False, "science_ready", _ONE_OF(*QC_POLICIES), "invalid_value"),
    "variables": (True, None, lambda v: _EACH_OF(VARIABLES)(v) and len(v) > 0, "unknown_variable"),
}


def _fields(value: Any, shape: dict, path: str, found: list[tuple[str, str]]) -> dict:
    """``value`` with its defaults; what does not fit ``shape`` goes to ``found``."""
    at = lambda k: f"{path}.{k}" if path else k
    if not isinstance(value, dict):
        found.append((path or "plan", "invalid_value"))
        return {k: default for k, (_, default, _, _) in shape.items()}
    found += [(at(k), "unknown_field") for k in value if k not in shape]
    out = {}
    for k, (required, default, test, code) in shape.items():
        out[k] = value.get(k, default)
        if k not in value:
            if required:
                found.append((at(k), "missing_field"))
        elif value[k] is None and not required and default is None:
            continue
        elif not test(value[k]):
            found.append((at(k), code))
    return out


def _tagged(value: Any, shapes: dict, path: str, found: list[tuple[str, str]]) -> dict:
    if not isinstance(value, dict) or value.get("kind") not in shapes:
        found.append((path, "invalid_value"))
        return {"kind": None}
    kind = value["kind"]
    return {"kind": kind} | _fields({k: v for k, v in value.items() if k != "kind"}, shapes[kind], path, found)


def _read(plan: Any) -> tuple[dict, list[tuple[str, str]]]:
    """(the plan with every default, what does not fit the form)."""
    found: list[tuple[str, str]] = []
    nested = {"time_range", "geography", "depth_dbar", "operation", "presentation"}
    if not isinstance(plan, dict):
        return {}, [("plan", "invalid_value")]
    out = _fields({k: v for k, v in plan.items() if k not in nested}, _TOP, "", found)
    for k in ("time_range", "geography", "operation"):
        if k not in plan:
            found.append((k, "missing_field"))
    out["time_range"] = _fields(plan["time_range"], _TIME, "time_range", found) if "time_range" in plan else {}
    out["geography"] = _tagged(plan["geography"], _GEOGRAPHY, "geography", found) if "geography" in plan else {}
    out["operation"] = _tagged(plan["operation"], _OPERATION, "operation", found) if "operation" in plan else {}
    out["depth_dbar"] = None if plan.get("depth_dbar") is None else _fields(plan["depth_dbar"], _DEPTH, "depth_dbar", found)
    out["presentation"] = _fields(plan.get("presentation", {}), _PRESENTATION, "presentation", found)
    return out, found


class _Single:
    """The tests of the rules on one plan's values; what is not given breaks no comparison."""

    more = staticmethod(lambda a, b: a is not None and b is not None and a > b)
    least = staticmethod(lambda a, b: a is not None and b is not None and a >= b)
    same = staticmethod(lambda a, b: a is not None and a == b)
    given = staticmethod(lambda a: a is not None)
    is_ = staticmethod(lambda a, *names: a in names)
    any_of = staticmethod(lambda xs, *names: any(x in names for x in xs or ()))
    all_of = staticmethod(lambda xs, *names: set(names) <= set(xs or ()))
    empty = staticmethod(lambda xs: not xs)
    twice = staticmethod(lambda xs: len(set(xs or ())) < len(xs or ()))
    no = staticmethod(lambda x: not x)


_sure = lambda c: F.coalesce(c, F.lit(False))
_list = lambda xs: F.coalesce(xs, F.array().cast("array<string>"))


class _Batch:
    """The same tests on columns."""

    more = staticmethod(lambda a, b: _sure(a > b))
    least = staticmethod(lambda a, b: _sure((a if isinstance(a, Column) else F.lit(a)) >= b))
    same = staticmethod(lambda a, b: _sure(a == b))
    given = staticmethod(lambda a: a.isNotNull())
    is_ = staticmethod(lambda a, *names: _sure(a.isin(*names)))
    any_of = staticmethod(lambda xs, *names: F.arrays_overlap(_list(xs), F.array(*map(F.lit, names))))
    all_of = staticmethod(lambda xs, *names: F.size(F.array_except(F.array(*map(F.lit, names)), _list(xs))) == 0)
    empty = staticmethod(lambda xs: F.size(_list(xs)) == 0)
    twice = staticmethod(lambda xs: F.size(F.array_distinct(_list(xs))) < F.size(_list(xs)))
    no = staticmethod(lambda x: ~x)


#: What the rules read of a plan: of a table of plans these are the columns.
RULE_FIELDS = (
    "span", "depth_min", "depth_max", "south", "north", "west", "east", "geo_km", "qc_policy", "kind", "presentation", "variables", "bins", "limit_", "radius_km", "k", "metrics", "group_by", "depth_bin_size",
)
_DAY = 86_400_000_000


def _rules(f: dict, t: Any, limit: dict[str, float]) -> list[tuple[Any, str, str]]:
    """(whether it is broken, path, code) of every rule across fields, for one plan or for columns alike. ``span`` is in microseconds."""
    kind, shown = (lambda *names: t.is_(f["kind"], *names)), (lambda *names: t.is_(f["presentation"], *names))
    aggregate, mismatch = kind("aggregate"), "operation_variable_mismatch"
    timed = t.any_of(f["group_by"], "month", "day")
    return [
        (t.least(0, f["span"]), "time_range", "invalid_time_range"),
        (t.more(f["span"], limit["time_span_days"] * _DAY), "time_range", "unbounded_request"),
        (t.least(f["depth_min"], f["depth_max"]), "depth_dbar", "invalid_depth_range"),
        (t.least(f["south"], f["north"]), "geography", "invalid_geography"),
        (t.same(f["west"], f["east"]), "geography", "invalid_geography"),
        (t.more(f["geo_km"], limit["nearest_radius_km"]), "geography.radius_km", "invalid_geography"),
        (t.is_(f["qc_policy"], "raw") & t.no(kind("profiles")), "qc_policy", mismatch),
        (shown("ts_diagram") & t.no(t.all_of(f["variables"], "temperature", "salinity")), "presentation.kind", mismatch),
        (shown("profile_plot", "ts_diagram") & t.no(kind("profiles")), "presentation.kind", mismatch),
        (shown("line_chart", "histogram", "scatter") & t.no(aggregate), "presentation.kind", mismatch),
        (shown("line_chart") & aggregate & t.no(timed), "presentation.kind", mismatch),
        (shown("map") & aggregate, "presentation.kind", mismatch),
        (t.given(f["bins"]) & t.no(shown("histogram")), "presentation.bins", "invalid_value"),
        (shown("histogram") & t.more(f["bins"], limit["histogram_bins"]), "presentation.bins", "unbounded_request"),
        (kind("profiles") & (t.no(t.given(f["limit_"])) | t.more(f["limit_"], limit["page_size"])), "operation.limit", "unbounded_request"),
        (kind("nearest") & t.more(f["radius_km"], limit["nearest_radius_km"]), "operation.radius_km", "invalid_geography"),
        (kind("nearest") & t.more(f["k"], limit["nearest_k"]), "operation.k", "unbounded_request"),
        (kind("nearest") & t.no(shown("table", "map")), "presentation.kind", mismatch),
        (aggregate & t.empty(f["metrics"]), "operation.metrics", "unbounded_request"),
        (aggregate & t.twice(f["metrics"]), "operation.metrics", "invalid_value"),
        (aggregate & t.twice(f["group_by"]), "operation.group_by", "invalid_value"),
        (aggregate & (t.any_of(f["group_by"], "depth_bin") & t.no(t.given(f["depth_bin_size"])) | t.no(t.any_of(f["group_by"], "depth_bin")) & t.given(f["depth_bin_size"])), "operation.depth_bin_size", "invalid_value"),
        (aggregate & t.no(timed | t.any_of(f["group_by"], "profile")) & t.more(f["span"], 31 * _DAY), "operation.group_by", "unbounded_request"),
    ]


def rule_fields(p: dict) -> dict:
    """RULE_FIELDS of a plan with its defaults."""
    op, geo, depth = p["operation"], p["geography"], p["depth_dbar"] or {}
    span = (datetime.fromisoformat(p["time_range"]["end"]) - datetime.fromisoformat(p["time_range"]["start"])) // timedelta(microseconds=1)
    found = {
        "span": span, "depth_min": depth.get("min"), "depth_max": depth.get("max"), "geo_km": geo.get("radius_km"), "qc_policy": p["qc_policy"], "kind": op["kind"],
        "presentation": p["presentation"]["kind"], "bins": p["presentation"]["bins"], "variables": p["variables"], "limit_": op.get("limit"),
    }
    return {k: geo.get(k) for k in ("south", "north", "west", "east")} | {k: op.get(k) for k in ("radius_km", "k", "metrics", "group_by", "depth_bin_size")} | found


def violations(plan: Any, limits: dict[str, float] | None = None) -> list[tuple[str, str]]:
    """(path, code) of everything that is wrong with a plan: its form, or else the rules across its fields."""
    p, found = _read(plan)
    return found or [(path, code) for broken, path, code in _rules(rule_fields(p), _Single, LIMITS | (limits or {})) if broken]


#: Fields that are measures: 40 and 40.0 are the same.
_MEASURES = ("west", "south", "east", "north", "longitude", "latitude", "radius_km", "min", "max")


def canonical(plan: dict) -> dict:
    """The plan with its defaults, variables in their order, and instants in UTC. Raises PlanError."""
    if found := violations(plan):
        raise PlanError(found)
    p, _ = _read(plan)
    utc = lambda v: datetime.fromisoformat(v).astimezone(UTC).isoformat().replace("+00:00", "Z")
    p["time_range"] = {k: utc(v) for k, v in p["time_range"].items()}
    p["variables"] = [v for v in VARIABLES if v in p["variables"]]
    for part in ("geography", "depth_dbar", "operation"):
        p[part] = p[part] and {k: float(v) if k in _MEASURES else v for k, v in p[part].items()}
    return p | {"plan_schema": PLAN_SCHEMA}


def plan_sha256(plan: dict) -> str:
    """Digest of the canonical plan as JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(canonical(plan), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# Running -----------------------------------------------------------------------------------------


def _where(profiles: DataFrame, geo: dict, edges: DataFrame | None) -> DataFrame:
    if geo["kind"] == "bbox":
        return profiles.where(in_bbox(geo["west"], geo["south"], geo["east"], geo["north"]))
    if geo["kind"] == "point_radius":
        return profiles.where(within_km(geo["longitude"], geo["latitude"], geo["radius_km"]))
    if edges is None:
        raise PlanError([("geography.value", "unknown_region")])
    return profiles.join(in_regions(profiles, edges.where(F.col("region") == geo["value"])), "profile_id", "left_semi")


def _in_months(frame: DataFrame, p: dict) -> DataFrame:
    """Only the months that a plan touches, where the frame carries them: a scan of stored slots reads no other directory."""
    if "observation_month" not in frame.columns:
        return frame
    first, end = (datetime.fromisoformat(p["time_range"][k]) for k in ("start", "end"))
    months = [at.strftime("%Y-%m-01") for at in (first, end - timedelta(microseconds=1))]
    return frame.where(F.col("observation_month").between(*[F.lit(m).cast("date") for m in months]))


def _in_tiles(frame: DataFrame, geo: dict) -> DataFrame:
    """Only the tiles that meet a plan's box, where the frame carries them: row groups of other tiles are not read."""
    if "tile" not in frame.columns or geo["kind"] != "bbox":
        return frame
    keys = box_tile_keys(geo["west"], geo["south"], geo["east"], geo["north"])
    return frame.where(F.col("tile").isin(keys)) if keys else frame


def _in_time(profiles: DataFrame, p: dict) -> DataFrame:
    at = lambda k: F.lit(p["time_range"][k]).cast("timestamp")
    return _in_months(profiles, p).where((F.col("observed_at") >= at("start")) & (F.col("observed_at") < at("end")))


def _slot(frame: DataFrame) -> list[str]:
    return [c for c in SLOT if c in frame.columns]


def _met(heads: DataFrame, levels: DataFrame, how: str = "inner") -> DataFrame:
    """Headers with levels, on the slot too where both carry it."""
    on = ["profile_id", *[c for c in _slot(heads) if c in levels.columns]]
    return heads.join(levels.select(*on) if how == "left_semi" else levels, on, how)


def _banded(levels: DataFrame, p: dict, policy: str) -> DataFrame:
    """Levels with the selected values p, t, s, in the depth band. The depth of a raw plan is the delivered one."""
    held = _in_tiles(_in_months(levels, p), p["geography"]) if p["operation"]["kind"] != "nearest" else _in_months(levels, p)
    rows = held.select("profile_id", *_slot(levels), "level_index", *[qc_value(v, policy).alias(v[0]) for v in ("pressure", "temperature", "salinity")])
    return rows if p["depth_dbar"] is None else rows.where(F.col("p").between(p["depth_dbar"]["min"], p["depth_dbar"]["max"]))


def run_plan(plan: dict, profiles: DataFrame, levels: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The rows of a plan over headers and levels; ``edges`` are the named regions' polygon edges.

    ``profiles``: headers, newest first (with one row more than the limit if more follow). ``nearest``: headers
    with ``metres``; the plan's geography selects nothing there. ``aggregate``: keys and ``{variable}_{metric}``.
    """
    p = canonical(plan)
    op, heads = p["operation"], _in_time(profiles, p)
    policy = "mode_selected" if p["qc_policy"] == "raw" else p["qc_policy"]
    if op["kind"] == "nearest":
        d = geo_distance(F.col("longitude"), F.col("latitude"), F.lit(op["longitude"]), F.lit(op["latitude"]))
        near = heads.where(within_km(op["longitude"], op["latitude"], op["radius_km"])).withColumn("metres", d)
        if p["depth_dbar"] is not None:
            near = _met(near, _banded(levels, p, policy), "left_semi")
        return near.orderBy("metres", "profile_id").limit(op["k"])
    heads = _where(heads, p["geography"], edges)
    if op["kind"] == "profiles":
        if p["depth_dbar"] is not None:
            heads = _met(heads, _banded(levels, p, policy), "left_semi")
        if op["cursor"]:
            at, pid = op["cursor"].split("|", 1)
            at = F.lit(at).cast("timestamp")
            heads = heads.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("profile_id") < pid)))
        return heads.orderBy(F.desc("observed_at"), F.desc("profile_id")).limit(op["limit"] + 1)
    names = list(op["group_by"])
    region = p["geography"].get("value", "Envelope")
    keys = [agg.key(k, op["depth_bin_size"] or 100, region) for k in names]
    rows = _met(heads, _banded(levels, p, policy))
    return agg.aggregate(rows, keys, names, {v: F.col(v[0]) for v in p["variables"]}, tuple(op["metrics"]), op["unit"])


def run_raw(plan: dict, profiles: DataFrame, levels: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The stored columns of the levels behind a raw plan's profiles, in the page's order: every variant, QC and mode of its variables."""
    p = canonical(plan)
    if p["qc_policy"] != "raw":
        raise PlanError([("qc_policy", "operation_variable_mismatch")])
    page = run_plan(plan, profiles, levels, edges).limit(p["operation"]["limit"]).select("profile_id", *_slot(profiles), "observed_at")
    band = p["depth_dbar"]
    rows = _in_tiles(_in_months(levels, p), p["geography"])
    if band is not None:
        rows = rows.where(qc_value("pressure", "mode_selected").between(band["min"], band["max"]))
    columns = [c for v in ("pressure", *[v for v in p["variables"] if v != "pressure"]) for c in raw_columns(v, levels.columns)]
    found = _met(rows, page)
    return found.select("profile_id", "observed_at", "level_index", *columns).orderBy(F.desc("observed_at"), F.desc("profile_id"), "level_index")


def provenance(plan: dict, result: DataFrame, profiles: DataFrame, coverage: DataFrame | None = None, attribution: dict[str, str] | None = None, versions: dict[str, str] | None = None) -> DataFrame:
    """One row beside a result: plan digest, rows, digest of the rows, what the plan's slots hold, versions, attribution.

    The digest adds up a hash of each row, so it holds for results of any size and order; doubles count to nine places.
    ``coverage``: rows of ``operators.coverage.resolve`` for the plan's slots (their ``state``); without it the three counts are null.
    ``attribution`` names the sources to be credited, ``versions`` what else made the result; both come back as maps, with the plan's own versions.
    """
    p = canonical(plan)
    cells = F.concat_ws("\x1f", *[F.coalesce((F.round(c, 9) if t == "double" else F.col(c)).cast("string"), F.lit("\x00")) for c, t in sorted(result.dtypes)])
    each = result.select(F.conv(F.substring(F.sha2(cells, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    folded = each.agg(F.count("*").alias("row_count"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("_sum"))
    covered = _in_time(profiles, p).agg(F.countDistinct("observation_month").alias("months_covered"), F.count("*").alias("profiles_in_time"))
    made = folded.join(covered, how="cross")  # one row each
    held = ("covered", "empty_verified")
    if coverage is not None:
        slots = coverage.agg(F.count("*").alias("slots_total"), F.count_if(F.col("state").isin(*held)).alias("slots_covered"))
        made = made.join(slots.withColumn("slots_missing", F.col("slots_total") - F.col("slots_covered")), how="cross")
    else:
        made = made.withColumns({c: F.lit(None).cast("long") for c in ("slots_total", "slots_covered", "slots_missing")})
    mapped = lambda d: F.create_map(*[F.lit(x) for pair in sorted(d.items()) for x in pair]) if d else F.create_map().cast("map<string,string>")
    return made.select(
        F.lit(plan_sha256(plan)).alias("plan_sha256"), "row_count", F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), "_sum"), 256).alias("result_sha256"),
        "months_covered", "profiles_in_time", "slots_total", "slots_covered", "slots_missing", F.lit(p["qc_policy"]).alias("qc_policy"), F.lit(PLAN_SCHEMA).alias("plan_schema"),
        F.lit(json.dumps(p["geography"], sort_keys=True)).alias("geography"), mapped({"plan_schema": PLAN_SCHEMA, "qc_policy": p["qc_policy"]} | (versions or {})).alias("versions"), mapped(attribution or {}).alias("attribution"),
    )


# A table of plans ----------------------------------------------------------------------------------


def codes(limits: dict[str, float] | None = None) -> Column:
    """Codes (path:code) of the rules that a row of plan columns breaks, in order: the columns are RULE_FIELDS, with start and end for the span."""
    fields = {c: F.col(c) for c in RULE_FIELDS if c != "span"} | {"span": F.unix_micros("end") - F.unix_micros("start")}
    rules = _rules(fields, _Batch, LIMITS | (limits or {}))
    return F.array_compact(F.array(*[F.when(broken, F.lit(f"{path}:{code}")) for broken, path, code in rules]))


def plan_text() -> Column:
    """The canonical plan of a row as ``plan_sha256`` reads it, JSON with sorted keys and no blanks.

    Columns: RULE_FIELDS without span, start, end, geography (its kind), region, geo_longitude, geo_latitude, longitude, latitude, cursor, unit.
    """
    text = lambda **fields: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.col(v)).alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})
    geo, op = F.col("geography"), F.col("kind")
    place = (
        F.when(geo == "bbox", text(kind=geo, west="west", south="south", east="east", north="north"))
        .when(geo == "point_radius", text(kind=geo, longitude="geo_longitude", latitude="geo_latitude", radius_km="geo_km")).otherwise(text(kind=geo, value="region"))
    )
    work = (
        F.when(op == "aggregate", text(kind=op, group_by="group_by", metrics="metrics", unit="unit", depth_bin_size="depth_bin_size"))
        .when(op == "nearest", text(kind=op, longitude="longitude", latitude="latitude", radius_km="radius_km", k="k")).otherwise(text(kind=op, limit="limit_", cursor="cursor"))
    )
    instant = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(c) % 1_000_000 != 0, F.date_format(c, ".SSSSSS")).otherwise(""), F.lit("Z"))
    named = F.array_intersect(F.array(*map(F.lit, VARIABLES)), F.col("variables"))
    depth = F.when(F.col("depth_max").isNull(), "null").otherwise(text(min="depth_min", max="depth_max"))
    parts = {
        "dataset": F.lit('"core"'), "depth_dbar": depth, "geography": place, "operation": work, "plan_schema": F.lit(f'"{PLAN_SCHEMA}"'), "presentation": text(kind="presentation", bins="bins"),
        "qc_policy": F.concat(F.lit('"'), F.col("qc_policy"), F.lit('"')), "time_range": text(start=instant(F.col("start")), end=instant(F.col("end"))), "variables": F.to_json(named),
    }
    pieces = [x for i, (k, v) in enumerate(sorted(parts.items())) for x in (F.lit(f'{"," if i else ""}"{k}":'), v)]
    return F.concat(F.lit("{"), *pieces, F.lit("}"))
