"""Streaming forms over the event log, drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.operators.revisions import revision_outcome
from castline.registry import query, r6
from castline.scratch import new_path
from castline.streaming.drain import drained, events_stream, into_batches
from castline.streaming.state import appended, capped, latest, publish_new


def _events(t):
    return events_stream(t.spark, t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("st_tumbling", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value) + 1e-9, 6) AS total FROM events GROUP BY 1, 2")
def _(t):
    """Daily tumbling windows by event time."""
    made = _events(t).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    made = made.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    return _latest(t, made, ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", r6(F.col("total"), "total"))


def _latest(t, stream, keys):
    return latest(stream, keys, new_path(t.spark, "stream"), new_path(t.spark, "marks"))


@query("st_dedupe", "SELECT count(DISTINCT event_id) AS n FROM events")
def _(t):
    """Events that arrive twice are let through once within the watermark."""
    twice = _events(t).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"))
    once = twice.withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["event_id"])
    return drained(once.select("event_id"), "append").agg(F.count("*").alias("n"))


@query("st_event_resume", "SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def _(t):
    """A log that is followed, left, and followed again: the second run reads on where the checkpoint of the first ends."""
    half = t.events.select((F.max("event_id") / 2).cast("long").alias("_half"))
    rows = t.events.select("event_id", "event_type").join(F.broadcast(half), how="cross")  # one row
    log, out, marks = (new_path(t.spark, n) for n in ("log", "stream", "marks"))
    for run, part in enumerate((rows.where("event_id <= _half"), rows.where("event_id > _half"))):
        part.select("event_id", "event_type").write.mode("append").parquet(log)
        stream = t.spark.readStream.schema("event_id long, event_type string").parquet(log)
        into_batches(stream, f"{out}/run={run}", marks)
    return t.spark.read.schema("event_id long, event_type string").parquet(f"{out}/run=1").select("event_id", "event_type")


@query("st_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS at FROM events GROUP BY 1")
def _(t):
    made = _events(t).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("at"))
    return _latest(t, made, ["user_id"])


@query("st_daily_caps", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value) + 1e-9, 6) AS spent, sum(value) > 15000 AS over_cap FROM events GROUP BY 1")
def _(t):
    made = _events(t).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day")).agg(F.sum("value").alias("spent")).select(F.col("window.start").alias("start"), "spent")
    return _latest(t, made, ["start"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), r6(F.col("spent"), "spent"), (F.col("spent") > 15000).alias("over_cap"))


@query("st_incremental", "SELECT event_type, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM events GROUP BY 1")
def _(t):
    """Landed rows, each landed twice and the second time after a restart, published once: a batch asks the state for its contents."""
    rows = t.events.select("event_id", "event_type", "value")
    log, published, marks = (new_path(t.spark, n) for n in ("log", "published", "marks"))
    for _ in range(2):
        rows.write.mode("append").parquet(log)
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(log)
        state = publish_new(stream, published, marks)
    return state.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value") + 1e-9, 4).alias("total"))


@query("st_caps_by_call", """WITH b AS (SELECT user_id % 20 AS payer, event_id, strftime(ts, '%Y-%m-%d') AS day, value, coalesce(sum(value) OVER (PARTITION BY user_id % 20, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
 SELECT event_id, CAST(payer AS BIGINT) AS payer, day, before < 120 AS allowed FROM b""")
def _(t):
    """Each call held against the day's spending of its payer before it, call by call."""
    calls = _events(t).select((F.col("user_id") % 20).cast("long").alias("payer"), F.col("event_id").cast("long").alias("call_id"), F.col("ts").alias("at"), F.col("value").cast("double").alias("cost"))
    out = new_path(t.spark, "stream")
    judged = capped(calls, ["payer"], 120.0)
    appended(judged, out, new_path(t.spark, "marks"))
    read = t.spark.read.schema(judged.schema).parquet(out)
    return read.select(F.col("call_id").alias("event_id"), "payer", F.date_format("day", "yyyy-MM-dd").alias("day"), "allowed")


@query("st_late_corrections", """WITH s AS (SELECT o_custkey AS k, max(o_orderkey) AS r, arg_max(o_orderstatus, o_orderkey) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
 c AS (SELECT o_orderkey, o_custkey AS k, o_orderkey AS r, o_orderstatus AS h, o_orderdate AS seen FROM orders)
 SELECT o_orderkey, CASE WHEN seen < TIMESTAMP '1996-01-01' THEN 'out_of_window' WHEN s.h IS NULL THEN 'insert' WHEN c.r = s.r THEN 'noop' WHEN c.r > s.r THEN CASE WHEN c.h = s.h THEN 'revision_only' ELSE 'newer' END ELSE 'stale_skip' END AS outcome FROM c LEFT JOIN s ON s.k = c.k""")
def _(t):
    """Late rows are corrections: judged by the order of revisions, not dropped; those outside the window go to a table of their own."""
    revision = lambda c: F.create_map(F.lit("core"), F.col(c).cast("long"))
    last = t.orders.where("o_orderdate < TIMESTAMP '1998-01-01'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("r"), F.max_by("o_orderstatus", "o_orderkey").alias("stored_hash"))
    stored = last.select("o_custkey", "stored_hash", revision("r").alias("stored"))
    log, judged, side, marks = (new_path(t.spark, n) for n in ("log", "judged", "late", "marks"))
    t.orders.write.parquet(log)

    def batch(rows, number):
        inside = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")
        both = rows.where(inside).join(stored, "o_custkey", "left")
        outcome = revision_outcome(F.col("stored_hash"), F.col("o_orderstatus"), F.col("stored"), revision("o_orderkey"))
        both.select("o_orderkey", outcome.alias("outcome")).write.mode("overwrite").parquet(f"{judged}/batch={number}")
        rows.where(~inside).select("o_orderkey", F.lit("out_of_window").alias("outcome")).write.mode("overwrite").parquet(f"{side}/batch={number}")

    stream = t.spark.readStream.schema(t.orders.schema).parquet(log)
    stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    read = lambda path: t.spark.read.schema("o_orderkey long, outcome string").parquet(path)
    return read(judged).unionByName(read(side)).select("o_orderkey", "outcome")
