"""Sources and sinks: files are landed from the bridge frames in the shared folder, then read or written by the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.functions.geo import tile_key
from castline.functions.qc import VARIABLES
from castline.registry import query
from castline.scratch import new_path
from castline.sinks import writers
from castline.sources import readers

_PARTS = ", ".join(readers.PART_COLUMNS[2:])


def landed(df, name: str) -> str:
    """Path of ``df`` written as Parquet."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def part_rows(t):
    rows = t.levels.join(t.profiles.select("profile_id", "profile_hash"), "profile_id").withColumn("level_index", F.col("level_index").cast("int"))
    return rows.select("profile_id", "profile_hash", "level_index", *readers.PART_COLUMNS[2:])


@query("src_parts", f"SELECT profile_id, profile_hash, {_PARTS} FROM b_levels JOIN b_profiles USING (profile_id) WHERE temperature_data_mode = 'R'")
def _(t):
    return readers.read_parts(t.spark, landed(part_rows(t), "parts")).where("temperature_data_mode = 'R'")


def manifest_rows(t):
    """Members of slots as rows; profiles of cycles that leave 1 by 3 are listed with the hash of an older content."""
    listed = t.profiles.where("cycle_number % 3 < 2").withColumn("profile_hash", F.when(F.col("cycle_number") % 3 == 0, F.col("profile_hash")).otherwise(F.md5("profile_hash")))
    return listed.select("observation_month", tile_key(F.col("longitude"), F.col("latitude")).alias("tile"), "profile_id", "profile_hash")


@query("src_members", "SELECT profile_id, profile_hash, platform_number, observed_at FROM b_profiles WHERE observed_at >= TIMESTAMP '1996-01-01' AND observed_at < TIMESTAMP '1996-07-01' AND cycle_number % 3 = 0")
def _(t):
    plan = t.profiles.where((F.col("observed_at") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("observed_at") < F.lit("1996-07-01").cast("timestamp")))
    return readers.members(plan, manifest_rows(t)).select("profile_id", "profile_hash", "platform_number", "observed_at")


@query("src_active_parts", """SELECT o_orderkey AS part_id, o_custkey AS logical_key, o_orderkey % 3 AS slot_version FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderkey % 3 = c_nationkey % 3
 WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def _(t):
    parts = t.orders.select(F.col("o_orderkey").alias("part_id"), F.col("o_custkey").alias("logical_key"), (F.col("o_orderkey") % 3).alias("slot_version"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("retired").alias("state"))
    commits = t.lineitem.select(F.col("l_orderkey").alias("part_id"), (F.col("l_linestatus") == "F").alias("committed"))
    slots = t.customer.select(F.col("c_custkey").alias("logical_key"), (F.col("c_nationkey") % 3).alias("slot_version"))
    return readers.active_parts(parts, commits, slots).select("part_id", "logical_key", "slot_version")


def documents_json(t):
    """Column-oriented profile documents, as a source delivers them: arrays by name, non-finite values spelled out."""
    text = lambda c, missing: F.when(missing, F.lit('"NaN"')).otherwise(c.cast("string"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    columns = [(F.col("p"), F.col("p_qc")), (F.col("t"), F.col("t_qc")), (F.col("s"), F.col("s_qc"))]
    cells = [x for v, qc in columns for x in (text(v, qc == "5"), quoted(qc))]
    level = F.struct("level_index", *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    held = t.delivered.groupBy("profile_id").agg(F.array_sort(F.collect_list(level)).alias("a"), F.min("data_mode").alias("mode"))
    array = lambda i: F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x[f"c{i}"]), ","), F.lit("]"))
    names = ",".join(f'"{n}"' for v in VARIABLES for n in (v, f"{v}_argoqc"))
    unit = lambda v: F.concat(F.lit(f'["{writers.UNITS[v]}","'), F.col("mode"), F.lit('"]'))
    info = F.concat(F.lit(f'[[{names}],["units","data_keys_mode"],['), F.concat_ws(",", *[x for v in VARIABLES for x in (unit(v), unit(v))]), F.lit("]]"))
    heads = held.join(t.profiles, "profile_id")
    return heads.select(
        "profile_id", "cycle_number",
        F.concat(
            F.lit('{"_id":"'), "profile_id", F.lit('","timestamp":"'), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","cycle_number":'), F.col("cycle_number").cast("string"),
            F.lit(',"geolocation":{"type":"Point","coordinates":['), F.col("longitude").cast("string"), F.lit(","), F.col("latitude").cast("string"), F.lit(']},"metadata":["'), "platform_number",
            F.lit('_m0"],"data_info":'), info, F.lit(',"data":['), F.concat_ws(",", *[array(i) for i in range(6)]), F.lit("]}"),
        ).alias("json"),
    )


_MODED = "SELECT d.*, min(data_mode) OVER (PARTITION BY profile_id) AS mode FROM b_delivered d"
_PLACED = ", ".join(
    f"CASE WHEN mode = 'R' THEN {v} END AS {n}, CASE WHEN mode <> 'R' THEN {v} END AS {n}_adjusted, CASE WHEN mode = 'R' THEN {c}_qc END AS {n}_qc, CASE WHEN mode <> 'R' THEN {c}_qc END AS {n}_adjusted_qc, mode AS {n}_data_mode"
    for n, c in zip(VARIABLES, "pts", strict=True) for v in [f"CASE WHEN {c}_qc <> '5' THEN {c} END"]
)


@query("src_profile_json", f"SELECT profile_id, CAST(level_index AS INT) AS level_index, {_PLACED} FROM ({_MODED})")
def _(t):
    path = new_path(t.spark, "documents")
    documents_json(t).select("json").write.text(path)
    return readers.flatten_profiles(t.spark.read.text(path), "value")


@query("src_profile_json_legacy", "SELECT profile_id, CAST(level_index AS INT) AS level_index, p AS pressure, CASE WHEN t_qc <> '4' THEN t END AS temperature, s AS salinity FROM b_delivered")
def _(t):
    """Ascending profiles as lists of level objects in capitals, the others as an object of arrays in small letters."""
    held = t.delivered.join(t.profiles.select("profile_id", "direction"), "profile_id")
    value = F.when(F.col("t_qc") != "4", F.col("t").cast("string")).otherwise("NaN")
    level = F.struct("level_index", F.col("p").cast("string").alias("PRES"), value.alias("TEMP"), F.col("s").cast("string").alias("PSAL"))
    a = held.groupBy("profile_id", "direction").agg(F.array_sort(F.collect_list(level)).alias("a"))
    listed = F.to_json(F.transform("a", lambda x: F.struct(x["PRES"].alias("PRES"), x["TEMP"].alias("TEMP"), x["PSAL"].alias("PSAL"))))
    arrays = F.to_json(F.struct(*[F.col("a")[n].alias(n.lower()) for n in ("PRES", "TEMP", "PSAL")]))
    docs = a.select("profile_id", F.when(F.col("direction") == "A", listed).otherwise(arrays).alias("measurements"))
    return readers.flatten_measurements(docs)


_FILE = "'dac/' || platform_number || '/profiles/' || direction || profile_id || '_' || lpad(CAST(cycle_number AS VARCHAR), 3, '0') || '.nc'"
_INDEX = f"SELECT {_FILE} AS file, strftime(observed_at, '%Y%m%d%H%M%S') AS date, longitude, latitude FROM b_profiles"


def index_rows(t):
    file = F.concat(F.lit("dac/"), "platform_number", F.lit("/profiles/"), "direction", "profile_id", F.lit("_"), F.lpad(F.col("cycle_number").cast("string"), 3, "0"), F.lit(".nc"))
    return t.profiles.select(file.alias("file"), F.date_format("observed_at", "yyyyMMddHHmmss").alias("date"), "longitude", "latitude", "cycle_number")


@query("src_index_csv", f"SELECT file, date, latitude, longitude FROM ({_INDEX} WHERE cycle_number % 17 <> 0 AND cycle_number % 19 <> 0) WHERE date >= '19960101000000' AND date < '19980101000000' AND longitude BETWEEN 40 AND 90 AND latitude BETWEEN -30 AND 25")
def _(t):
    i = index_rows(t)
    line = F.concat_ws(",", "file", F.when(F.col("cycle_number") % 17 != 0, F.col("date")).otherwise(""), F.when(F.col("cycle_number") % 19 != 0, F.col("latitude").cast("string")).otherwise(""), F.col("longitude").cast("string"), F.lit("I"), F.lit("846"), F.lit("XX"), F.col("date"))
    head = t.spark.createDataFrame([("# Title : profile index",), ("file,date,latitude,longitude,ocean,profiler_type,institution,date_update",)], "value string")
    path = new_path(t.spark, "index")
    head.unionByName(i.select(line.alias("value"))).write.text(path)
    return readers.read_profile_index(t.spark, path, "19960101000000", "19980101000000", (40, -30, 90, 25))


@query("src_index_owned", f"SELECT file, date FROM ({_INDEX}) WHERE date >= '19960101000000' AND date < '19980101000000' AND longitude >= 70 AND longitude < 80 AND latitude >= 20 AND latitude <= 30")
def _(t):
    return readers.index_entries(index_rows(t), "19960101000000", "19980101000000", "70_20").select("file", "date")


def profile_arrays(t):
    """Wide arrays with fill values: of levels with bad QC, of some positions and times."""
    fill = lambda bad, v: F.when(bad, readers.FILL).otherwise(v)
    level = F.struct("level_index", fill(F.col("p_qc") == "5", F.col("p")).alias("p"), fill(F.col("t_qc") == "4", F.col("t")).alias("t"), fill(F.col("s_qc") == "3", F.col("s")).alias("s"))
    a = t.delivered.groupBy("profile_id").agg(F.array_sort(F.collect_list(level)).alias("a"))
    juld = (F.unix_timestamp("observed_at") - F.unix_timestamp(F.lit("1950-01-01").cast("timestamp"))) / 86400.0
    heads = t.profiles.select("profile_id", fill(F.col("cycle_number") % 13 == 5, F.col("latitude")).alias("latitude"), "longitude", fill(F.col("cycle_number") % 11 == 3, juld).alias("juld"))
    return a.join(heads, "profile_id").select("profile_id", "latitude", "longitude", "juld", *[F.col("a")[c].alias(n) for c, n in zip("pts", VARIABLES, strict=True)])


_ARRAYS = """WITH v AS (SELECT d.profile_id, level_index, CASE WHEN p_qc <> '5' THEN p END AS pressure, CASE WHEN t_qc <> '4' THEN t END AS temperature, CASE WHEN s_qc <> '3' THEN s END AS salinity, cycle_number FROM b_delivered d JOIN b_profiles m ON m.profile_id = d.profile_id),
 l AS (SELECT profile_id, max(CASE WHEN pressure IS NOT NULL OR temperature IS NOT NULL OR salinity IS NOT NULL THEN level_index END) AS last, any_value(cycle_number) AS c FROM v GROUP BY 1)"""


@query("src_array_profiles", f"{_ARRAYS} SELECT v.profile_id, CAST(level_index AS INT) AS level_index, pressure, temperature, salinity FROM v JOIN l ON l.profile_id = v.profile_id AND level_index <= last WHERE c % 13 <> 5 AND c % 11 <> 3")
def _(t):
    return readers.trim_profile_arrays(profile_arrays(t))


@query("src_array_exclusions", f"{_ARRAYS} SELECT CASE WHEN c % 13 = 5 THEN 'no_position' WHEN c % 11 = 3 THEN 'no_time' ELSE 'no_level' END AS excluded, count(*) AS n FROM l WHERE c % 13 = 5 OR c % 11 = 3 OR last IS NULL GROUP BY 1")
def _(t):
    return readers.array_exclusion(profile_arrays(t)).where("excluded IS NOT NULL").groupBy("excluded").agg(F.count("*").alias("n"))


@query("src_snapshot", "SELECT platform_number, observed_at AS date, 1::BIGINT AS date_qc, cycle_number, direction, 1::BIGINT AS position_qc, longitude AS lon, latitude AS lat, t AS temp, s AS psal, p AS pres FROM b_delivered d JOIN b_profiles m ON m.profile_id = d.profile_id WHERE p < 1000")
def _(t):
    one = F.lit(1).cast("long")
    rows = t.delivered.join(t.profiles, "profile_id").select(
        "platform_number", F.col("observed_at").alias("date"), one.alias("date_qc"), "cycle_number", "direction", one.alias("position_qc"),
        F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.col("t").alias("temp"), F.col("s").alias("psal"), F.col("p").alias("pres"),
    )
    return readers.read_snapshot(t.spark, landed(rows, "snapshot")).where("pres < 1000")


@query("src_regions", """WITH r AS (SELECT CASE WHEN c_custkey % 10 = 1 THEN 'area of ' || c_mktsegment ELSE c_name END AS name, 'POINT (' || c_nationkey || ' ' || c_custkey || ')' AS wkt, c_custkey % 7 = 0 AS bad FROM customer)
 SELECT name, wkt, CASE WHEN bad THEN 'digest_mismatch' WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'duplicate_name' ELSE 'ok' END AS verdict FROM r""")
def _(t):
    name = F.when(F.col("c_custkey") % 10 == 1, F.concat(F.lit("area of "), "c_mktsegment")).otherwise(F.col("c_name"))
    wkt = F.concat(F.lit("POINT ("), F.col("c_nationkey").cast("string"), F.lit(" "), F.col("c_custkey").cast("string"), F.lit(")"))
    records = t.customer.select(name.alias("name"), wkt.alias("wkt"), "c_custkey").withColumn("sha256", F.when(F.col("c_custkey") % 7 == 0, "0").otherwise(F.sha2("wkt", 256)))
    return readers.read_regions(records)


@query("src_daily_keys", """SELECT o_orderkey, strftime(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate + to_days(CAST(o_orderkey % 4 AS INT)) - INTERVAL 1 MICROSECOND AS DATE), INTERVAL 1 DAY)), '%Y/%m/%Y%m%d') || '_prof.nc' AS object_key
 FROM orders WHERE o_orderkey % 4 > 0""")
def _(t):
    """Keys of the days that each order's interval of 0 to 3 days touches."""
    end = F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 4).cast("int"))
    return t.orders.select("o_orderkey", F.explode(readers.daily_keys(F.col("o_orderdate"), end)).alias("object_key"))


# Sinks -------------------------------------------------------------------------------------------


@query("sink_levels", """SELECT CAST(observation_month AS VARCHAR) AS month, (CASE WHEN longitude = 120 THEN 110 ELSE CAST(floor((longitude - 20) / 10) * 10 + 20 AS INT) END) || '_' || (CASE WHEN latitude = 30 THEN 20 ELSE CAST(floor((latitude + 60) / 10) * 10 - 60 AS INT) END) AS tile,
 count(*) AS levels, count(DISTINCT l.profile_id) AS profiles, count(temperature) AS temperatures FROM b_levels l JOIN b_profiles m ON m.profile_id = l.profile_id WHERE observed_at >= TIMESTAMP '1997-01-01' AND observed_at < TIMESTAMP '1997-07-01' GROUP BY 1, 2""")
def _(t):
    """What the written slots of half a year (one directory each) hold, read back."""
    half = (F.col("observed_at") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("observed_at") < F.lit("1997-07-01").cast("timestamp"))
    heads = t.profiles.where(half).select("profile_id", "observation_month", tile_key(F.col("longitude"), F.col("latitude")).alias("tile"))
    rows, path = t.levels.join(heads, "profile_id"), new_path(t.spark, "levels")
    writers.write_levels(rows, path)
    back = t.spark.read.schema(rows.schema).parquet(path)
    return back.groupBy(F.col("observation_month").cast("string").alias("month"), "tile").agg(F.count("*").alias("levels"), F.countDistinct("profile_id").alias("profiles"), F.count("temperature").alias("temperatures"))


_SELECTED = """CASE WHEN {v}_data_mode = 'R' AND {v}_qc IN ('1','2') THEN {v} WHEN {v}_data_mode IN ('A','D') AND {v}_adjusted_qc IN ('1','2') THEN {v}_adjusted END AS {v}_selected, {v}, {v}_adjusted, {v}_qc, {v}_adjusted_qc, {v}_data_mode"""
_EXPORT = f"""SELECT l.profile_id, platform_number, cycle_number, direction, observed_at, longitude, latitude, level_index, {', '.join(_SELECTED.format(v=v) for v in VARIABLES)}
 FROM b_levels l JOIN b_profiles m ON m.profile_id = l.profile_id WHERE observed_at >= TIMESTAMP '1997-01-01' AND observed_at < TIMESTAMP '1997-03-01'"""


def _two_months(t):
    return t.profiles.where((F.col("observed_at") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("observed_at") < F.lit("1997-03-01").cast("timestamp")))


@query("sink_export", _EXPORT)
def _(t):
    path = new_path(t.spark, "export")
    writers.export_levels(t.levels, _two_months(t), path, "parquet")
    return t.spark.read.parquet(path)


@query("sink_export_csv", _EXPORT)
def _(t):
    """The same as CSV with a header, read back by its schema."""
    path, rows = new_path(t.spark, "export"), t.levels.join(_two_months(t).select(*writers.HEADER), "profile_id").select(*writers.export_columns("science_ready"))
    writers.export_levels(t.levels, _two_months(t), path, "csv")
    return t.spark.read.schema(rows.schema).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").csv(path)


@query("sink_manifest", f"""WITH e AS ({_EXPORT}) SELECT count(*) AS row_count, count(DISTINCT profile_id) AS profile_count, min(observed_at) AS first_at, max(observed_at) AS last_at, 'dbar' AS pressure_unit,
 CASE WHEN bool_or(false) THEN '' END AS qc_unit, repeat('0', 64) AS plan_sha256 FROM e""")
def _(t):
    """The manifest beside an export, read back."""
    data, path = new_path(t.spark, "export"), new_path(t.spark, "manifest")
    writers.export_levels(t.levels, _two_months(t), data, "parquet")
    writers.export_manifest(t.spark.read.parquet(data), path, "0" * 64)
    back = t.spark.read.schema("row_count long, profile_count long, first_at timestamp, last_at timestamp, units map<string,string>, plan_sha256 string").json(path)
    return back.select("row_count", "profile_count", "first_at", "last_at", F.col("units")["pressure_selected"].alias("pressure_unit"), F.col("units")["pressure_qc"].alias("qc_unit"), "plan_sha256")


@query("sink_corpus_upsert", """WITH c AS (SELECT lang AS doc_type, doc_id AS key, 'm1' AS model, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT lang AS doc_type, doc_id AS key, 'm1' AS model, sha256(CASE WHEN source = 'src3' THEN text || ' revised' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
 SELECT coalesce(n.doc_type, c.doc_type) AS doc_type, coalesce(n.key, c.key) AS key, 'm1' AS model, coalesce(n.h, c.h) AS content_sha256, CASE WHEN c.h IS NULL THEN 'embed' WHEN n.h IS NULL THEN 'retire' WHEN c.h = n.h THEN 'keep' ELSE 'embed_again' END AS action
 FROM c FULL JOIN n ON c.doc_type = n.doc_type AND c.key = n.key""")
def _(t):
    """Documents once stored against documents delivered: some are new, some gone, one source revised."""
    d = t.documents.select(F.col("lang").alias("doc_type"), F.col("doc_id").alias("key"), F.lit("m1").alias("model"), "text", "source")
    current = d.where("key % 5 <> 0").withColumn("content_sha256", F.sha2("text", 256))
    incoming = d.where("key % 7 <> 0").withColumn("content_sha256", F.sha2(F.when(F.col("source") == "src3", F.concat("text", F.lit(" revised"))).otherwise(F.col("text")), 256))
    return writers.upsert_documents(current, incoming)


@query("ing_verify_written", "SELECT 0::BIGINT AS missing, count(*) AS extra, count(*) = 0 AS same FROM b_profiles WHERE cycle_number % 9 = 2")
def _(t):
    """A part that was written with rows twice: none is missing, the repeated ones are extra."""
    rows = t.profiles.select("profile_id", "platform_number", "observed_at", "profile_hash")
    twice = rows.unionByName(t.profiles.where("cycle_number % 9 = 2").select(*rows.columns))
    return writers.verify_written(rows, landed(twice, "written"))
