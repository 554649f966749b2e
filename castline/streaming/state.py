"""Streams by keyed state: what a batch costs follows the batch, not what came before.

State lives in the session's state store (RocksDB is asked for, so that it need not fit in memory) under the checkpoint, which is
in the shared folder, so a lost executor and a restart both find it again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def appended(stream: DataFrame, path: str, marks: str) -> None:
    """Run a stream over all there is since checkpoint ``marks``; its rows go to Parquet, each batch exactly once."""
    with rocksdb(stream.sparkSession):
        stream.writeStream.option("checkpointLocation", marks).option("path", path).trigger(availableNow=True).outputMode("append").format("parquet").start().awaitTermination()


def publish_new(stream: DataFrame, path: str, marks: str, at: str | None = None, within: str = "30 days") -> DataFrame:
    """Publish the contents of ``stream`` that were not published before, and return all that is published.

    A batch looks up its own contents in the state, and reads nothing that is published. With an event time ``at`` a content is
    remembered for ``within``, so the state is bounded; without one it is remembered for good. Replays and restarts add nothing.
    """
    content = F.sha2(F.to_json(F.struct(*stream.columns), {"ignoreNullFields": "false"}), 256)
    marked = stream.withColumn("_content", content)
    once = marked.withWatermark(at, within).dropDuplicatesWithinWatermark(["_content"]) if at else marked.dropDuplicates(["_content"])
    appended(once, path, marks)
    return stream.sparkSession.read.schema(once.schema).parquet(path).select(*stream.columns)


def latest(stream: DataFrame, keys: list[str], path: str, marks: str) -> DataFrame:
    """The last row of each key of an aggregated stream. A batch writes only the keys that it changes; the newest batch of a key counts."""
    spark = stream.sparkSession
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    with rocksdb(spark):
        stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).outputMode("update").foreachBatch(write).start().awaitTermination()
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long"
    rest = [c for c in stream.columns if c not in keys]
    found = spark.read.schema(schema).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return found.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def capped(calls: DataFrame, owner: list[str], cap: float, late: str = "2 days") -> DataFrame:
    """owner, day, call_id, at, cost, spent, allowed: each call held against what its owner spent that UTC day before it.

    ``calls``: owner, call_id, at (timestamp), cost. A call is allowed while the day's spending so far is under ``cap``, and only
    allowed ones are spent. State is one number for each owner and day, and leaves when the watermark passes the day; calls that come
    later than ``late`` are dropped with it. Calls of one batch are taken in order of time, then id.
    """
    day = F.date_trunc("day", "at")
    rows = calls.withWatermark("at", late).withColumn("day", day)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in owner)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent = state.get[0] if state.exists else 0.0
        found = pd.concat(list(batches)).sort_values(["at", "call_id"], kind="stable")  # one owner's calls of a day in one batch
        before, allowed = [], []
        for cost in found["cost"]:
            before.append(spent)
            allowed.append(spent < cap)
            spent += cost if spent < cap else 0.0
        state.update((spent,))
        closes = int(key[-1].timestamp() * 1000) + 86_400_000
        if closes > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(closes)
        yield found.assign(spent=before, allowed=allowed)[[*owner, "day", "call_id", "at", "cost", "spent", "allowed"]]

    out = f"{schema}, day timestamp, call_id long, at timestamp, cost double, spent double, allowed boolean"
    return rows.groupBy(*owner, "day").applyInPandasWithState(run, out, "spent double", "append", GroupStateTimeout.EventTimeTimeout)
