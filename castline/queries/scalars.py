"""Scalar functions over the driver tables: dates, strings, numbers, arrays, maps, JSON, geometry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.functions import numeric
from castline.bridge import GLOBE, globe
from castline.functions.dates import instant, shift_months
from castline.functions.geo import circle_boxes, tiles_of_boxes
from castline.operators import payload
from castline.operators.revisions import order_verdict
from castline.functions.text import STOP_WORDS, TOKEN, file_parts, label, numbers, tokens, url_clean
from castline.registry import query, r6


@query("dt_parse_strict", """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN strftime(CASE event_id % 4 WHEN 1 THEN ts - INTERVAL 330 MINUTE ELSE ts END, '%Y-%m-%d %H:%M:%S.%f') END AS at FROM events""")
def _(t):
    """Instants need a zone and six fraction digits at most: event times written in UTC, in +05:30, and without a zone."""
    k, plain = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(k == 1, F.concat(plain, F.lit("+05:30"))).when(k == 3, plain).otherwise(F.concat(plain, F.lit("Z")))
    return t.events.select("event_id", F.date_format(instant(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("dt_month_start", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH, '%Y-%m-%d') AS earlier FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.trunc("o_orderdate", "MM").cast("string").alias("month"), F.add_months(F.to_date("o_orderdate"), -1).cast("string").alias("earlier"))


@query("dt_shift_months", "SELECT event_id, strftime(ts - INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S.%f') AS earlier, strftime(ts + INTERVAL 13 MONTH, '%Y-%m-%d %H:%M:%S.%f') AS later FROM events")
def _(t):
    show = lambda n: F.date_format(shift_months(F.col("ts"), n), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return t.events.select("event_id", show(-1).alias("earlier"), show(13).alias("later"))


@query("dt_months_of", "SELECT o_orderkey, strftime(unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 3 MONTH, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM orders")
def _(t):
    start = F.trunc("o_orderdate", "MM")
    return t.orders.select("o_orderkey", F.explode(F.sequence(start, F.add_months(start, 3), F.expr("interval 1 month"))).alias("m")).select("o_orderkey", F.date_format("m", "yyyy-MM").alias("month"))


@query("dt_juld", "SELECT o_orderkey, CAST(epoch_us(o_orderdate) AS BIGINT) AS micros FROM orders")
def _(t):
    """Days since 1950 to an instant, to the microsecond and back: the round trip must not lose one."""
    epoch = F.unix_micros(F.lit("1950-01-01").cast("timestamp"))
    days = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) - epoch) / F.lit(86400e6)
    return t.orders.select("o_orderkey", (F.bround(days * 86400e6, 0).cast("long") + epoch).alias("micros"))


@query("dt_compact", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS compact, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def _(t):
    compact = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    return t.orders.select("o_orderkey", compact.alias("compact"), F.unix_timestamp(F.try_to_timestamp(compact, F.lit("yyyyMMddHHmmss"))).alias("seconds"))


@query("dt_windows", "SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '2001-05-01' - INTERVAL 3 MONTH) AS hot, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-05-01' - INTERVAL 12 MONTH) AS rolling FROM orders WHERE o_orderdate < TIMESTAMP '2001-05-01'")
def _(t):
    ref = F.lit("2001-05-01").cast("timestamp")
    back = lambda n: F.add_months(F.lit("2001-05-01").cast("date"), -n).cast("timestamp")
    at = F.col("o_orderdate")
    return t.orders.where(at < ref).agg(F.count_if(at >= back(3)).alias("hot"), F.count_if(at >= back(12)).alias("rolling"))


@query("dt_period_text", "SELECT o_orderstatus, CASE WHEN strftime(min(o_orderdate), '%Y-%m') = strftime(max(o_orderdate), '%Y-%m') THEN strftime(min(o_orderdate), '%B %Y') ELSE strftime(min(o_orderdate), '%B %Y') || ' to ' || strftime(max(o_orderdate), '%B %Y') END AS period FROM orders GROUP BY 1")
def _(t):
    name = lambda c: F.date_format(c, "MMMM yyyy")
    made = t.orders.groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return made.select("o_orderstatus", F.when(name("a") == name("b"), name("a")).otherwise(F.concat_ws(" to ", name("a"), name("b"))).alias("period"))


@query("str_identity", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'id:' || doc_id ELSE 'natural:[\"' || source || '\",\"' || lang || '\"]' END AS k FROM documents")
def _(t):
    natural = F.concat(F.lit("natural:"), F.to_json(F.array("source", "lang")))
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("id:"), F.col("doc_id").cast("string"))).otherwise(natural).alias("k"))


@query("str_platform_regex", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 4 THEN CAST(o_custkey AS VARCHAR) END AS platform, CASE WHEN o_orderkey % 9 <> 4 THEN o_orderkey % 400 END AS cycle, CASE WHEN o_orderkey % 9 <> 4 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'A' END END AS direction,
 CASE WHEN o_orderkey % 9 <> 4 THEN 'gdac:' || o_custkey || '_' || o_orderkey % 400 || CASE WHEN o_orderkey % 3 = 0 THEN 'D' ELSE 'A' END END AS identity FROM orders""")
def _(t):
    """Platform, cycle and direction from file names and paths; one name in nine is none of a profile."""
    k = F.col("o_orderkey")
    stem = F.concat(F.when(k % 2 == 0, "dac/x/R").otherwise("SD"), F.col("o_custkey").cast("string"), F.lit("_"), F.lpad((k % 400).cast("string"), 3, "0"), F.when(k % 3 == 0, "D").otherwise(""))
    name = F.concat(stem, F.when(k % 9 == 4, "_traj.nc").otherwise(".nc"))
    return t.orders.select("o_orderkey", file_parts(name).alias("f")).select("o_orderkey", "f.*")


@query("str_url_clean", "SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '^[^@]*@', '')) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS url FROM pages")
def _(t):
    return t.pages.select("page_id", url_clean(F.col("url")).alias("url"))


@query("str_qc_normalise", "SELECT l_orderkey, CASE WHEN l_linenumber % 4 IN (0, 1) THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS qc, l_linenumber % 4 = 0 AS unknown FROM lineitem")
def _(t):
    """A digit is a code, an empty text is none, anything else is unknown."""
    digit = F.col("l_linenumber").cast("string")
    code, unknown = payload.qc_normalised(F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("x"), digit)).when(F.col("l_linenumber") % 4 == 1, "").otherwise(digit))
    return t.lineitem.select("l_orderkey", code.alias("qc"), unknown.alias("unknown"))


@query("str_bounded", "SELECT doc_id, text <> '' AND strlen(text) <= 2000 AS ok FROM documents")
def _(t):
    return t.documents.select("doc_id", ((F.col("text") != "") & (F.octet_length("text") <= 2000)).alias("ok"))


@query("str_label", "SELECT event_type || '_mean' AS raw, 'mean ' || event_type AS label, count(*) AS n FROM events WHERE regexp_full_match(event_type, '[a-z]+') GROUP BY 1, 2")
def _(t):
    raw = F.concat("event_type", F.lit("_mean"))
    return t.events.where(F.col("event_type").rlike("^[a-z]+$")).groupBy(raw.alias("raw"), label(raw).alias("label")).agg(F.count("*").alias("n"))


@query("str_numbers", r"SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(left_text, '-?\d+(?:\.\d+)?'), lambda x: CAST(TRY_CAST(x AS DECIMAL(38,2)) AS VARCHAR)), 'string_agg', ',') AS numbers FROM (SELECT doc_id, text AS left_text FROM documents) WHERE regexp_matches(left_text, '\d')")
def _(t):
    return t.documents.where(F.col("text").rlike(r"\d")).select("doc_id", F.array_join(numbers(F.col("text")), ",").alias("numbers"))


@query("str_grounded", r"""WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations)
 SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '\d+'), lambda x: NOT list_contains(regexp_extract_all(source, '\d+'), x) AND CAST(x AS DOUBLE) > 4)) = 0 AS grounded FROM p WHERE role = 'assistant' AND asked = 'user'""")
def _(t):
    """Every number of an answer stands in the question before it, 0 to 4 aside."""
    w = W.partitionBy("conv_id").orderBy("turn")
    p = t.conversations.withColumns({"source": F.lag("text").over(w), "asked": F.lag("role").over(w)}).where("role = 'assistant' AND asked = 'user'")
    found, known = F.regexp_extract_all("text", F.lit(r"\d+"), 0), F.regexp_extract_all("source", F.lit(r"\d+"), 0)
    loose = F.exists(F.array_except(found, known), lambda x: x.cast("double") > 4)
    return p.select("conv_id", "turn", (~loose).alias("grounded"))


@query("str_tokens", f"SELECT conv_id, turn, list_aggregate(list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda x: x NOT IN {STOP_WORDS}), 'string_agg', ' ') AS tokens FROM conversations WHERE lang_ok(text)".replace("WHERE lang_ok(text)", r"WHERE NOT regexp_matches(text, '[^\x00-\x7F]')"))
def _(t):
    joined = F.array_join(tokens(F.col("text")), " ")
    return t.conversations.where(~F.col("text").rlike(r"[^\x00-\x7F]")).select("conv_id", "turn", F.nullif(joined, F.lit("")).alias("tokens"))


@query("num_fill", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 10 = 0 THEN 'fill' END AS reason FROM orders")
def _(t):
    value, reason = numeric.filled(F.when(F.col("o_orderkey") % 10 == 0, numeric.FILL).otherwise(F.col("o_totalprice")))
    return t.orders.select("o_orderkey", value.alias("value"), reason.alias("reason"))


@query("num_nonfinite", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN NULL ELSE o_totalprice END AS value FROM orders")
def _(t):
    """Every spelling of a value that is no number becomes null."""
    spelled = F.get(F.array(*map(F.lit, numeric.NONFINITE)), (F.col("o_orderkey") % 7).cast("int"))
    return t.orders.select("o_orderkey", numeric.number(F.coalesce(spelled, F.col("o_totalprice").cast("string"))).alias("value"))


@query("num_exact", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS value, l_linenumber % 2 = 0 OR CAST(round(l_extendedprice * 100) AS BIGINT) % 25 <> 0 AS rounded, l_linenumber = 3 AS overflow, l_linenumber = 5 AS underflow FROM lineitem""")
def _(t):
    """Decimal text to double: ``rounded`` tells a text that no double is. Line 3 also has an exponent too large, line 5 one too small."""
    text = F.concat(F.format_string("%.2f", F.col("l_extendedprice")), F.when(F.col("l_linenumber") % 2 == 0, "000000000000001").otherwise(""))
    rows = numeric.exact_numbers(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text")), "text")
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("value", 2).alias("value"), F.array_contains("flags", "rounded").alias("rounded"), F.concat("text", F.when(F.col("l_linenumber") == 3, "e400").when(F.col("l_linenumber") == 5, "e-400").otherwise("")).alias("beyond"))
    far = numeric.exact_numbers(rows.withColumnRenamed("value", "_kept"), "beyond")
    return far.select("l_orderkey", "l_linenumber", "l_partkey", F.col("_kept").alias("value"), "rounded", F.coalesce(F.col("reject") == "float64_overflow", F.lit(False)).alias("overflow"), F.coalesce(F.col("reject") == "float64_underflow", F.lit(False)).alias("underflow"))


_REACH = "greatest(abs(greatest(latitude - degrees(900 / 6371.0088e0), -90)), abs(least(latitude + degrees(900 / 6371.0088e0), 90)))"
_BOXES = f"""WITH g AS ({GLOBE}), c AS (SELECT profile_id, longitude AS x, greatest(latitude - degrees(900 / 6371.0088e0), -90) AS south, least(latitude + degrees(900 / 6371.0088e0), 90) AS north,
 CASE WHEN {_REACH} >= 90 - 1e-9 THEN 180 ELSE least(180, degrees(900 / (6371.0088e0 * cos(radians({_REACH}))))) END AS d FROM g),
 b AS (SELECT profile_id, south, north, CASE WHEN d >= 180 THEN -180 ELSE greatest(x - d, -180) END AS west, CASE WHEN d >= 180 THEN 180 ELSE least(x + d, 180) END AS east FROM c
  UNION ALL SELECT profile_id, south, north, x - d + 360, 180 FROM c WHERE d < 180 AND x - d < -180 UNION ALL SELECT profile_id, south, north, -180, x + d - 360 FROM c WHERE d < 180 AND x - d >= -180 AND x + d > 180)"""


def _boxed(t):
    return globe(t).select("profile_id", circle_boxes(F.col("longitude"), F.col("latitude"), F.lit(900.0)).alias("boxes"))


@query("geo_circle_box", f"{_BOXES} SELECT profile_id, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in ('west', 'south', 'east', 'north'))} FROM b")
def _(t):
    """Boxes of the 900 km circle around points all over the globe: two across 180 degrees, one all round at a pole."""
    return _boxed(t).select("profile_id", F.explode("boxes").alias("b")).select("profile_id", *[r6(F.col(f"b.{c}"), c) for c in ("west", "south", "east", "north")])


@query("geo_tiles_of_box", f"""{_BOXES} SELECT DISTINCT profile_id, CAST(20 + 10 * x AS BIGINT) AS west, CAST(10 * y - 60 AS BIGINT) AS south FROM b, (SELECT unnest(range(10)) AS x), (SELECT unnest(range(9)) AS y)
 WHERE east >= 20 + 10 * x AND (west < 30 + 10 * x OR (x = 9 AND west <= 120)) AND north >= 10 * y - 60 AND (b.south < 10 * y - 50 OR (y = 8 AND b.south <= 30))""")
def _(t):
    """Tiles of the grid that a circle's boxes meet, clamped to its envelope."""
    return _boxed(t).select("profile_id", F.explode(tiles_of_boxes(F.col("boxes"))).alias("c")).select("profile_id", "c.west", "c.south")


@query("arr_zip_levels", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem")
def _(t):
    """Parallel arrays to rows, and back from rows to arrays before."""
    row = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    packed = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(row).alias("r")).select("l_orderkey", *[F.col(f"r.{c}").alias(c) for c in ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")])
    return packed.select("l_orderkey", F.explode(F.arrays_zip("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).alias("z")).select("l_orderkey", "z.*")


@query("arr_last_valid", "SELECT l_orderkey, max(CASE WHEN l_discount > 0.05 THEN r END) AS last_valid FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r FROM lineitem) GROUP BY 1")
def _(t):
    """Last index of an array that holds a usable value."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    arrays = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("a"))
    index = F.array_max(F.transform("a", lambda x, i: F.when(x["l_discount"] > 0.05, i)))
    return arrays.select("l_orderkey", index.cast("long").alias("last_valid"))


@query("map_revision", "SELECT l_orderkey, CASE WHEN min(d) = 0 AND max(d) = 0 THEN 'equal' WHEN min(d) >= 0 THEN 'newer' WHEN max(d) <= 0 THEN 'older' ELSE 'mixed' END AS verdict FROM (SELECT l_orderkey, CAST(max(l_partkey) - max(l_suppkey) * 20 AS BIGINT) AS d FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1")
def _(t):
    """Component maps by order: a line number is a component, its part and supplier make the two revisions."""
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("new"), (F.max("l_suppkey") * 20).alias("old"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("l_linenumber", c)))
    maps = lines.groupBy("l_orderkey").agg(entry("new").alias("new"), entry("old").alias("old"))
    return maps.select("l_orderkey", order_verdict(F.col("old"), F.col("new")).alias("verdict"))


@query("json_canonical", """SELECT doc_id, '{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}' AS canonical, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS digest FROM documents""")
def _(t):
    text = F.to_json(F.struct("lang", "n_chars", "source"), {"ignoreNullFields": "false"})
    return t.documents.select("doc_id", text.alias("canonical"), F.sha2(text, 256).alias("digest"))


@query("hash_content", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
