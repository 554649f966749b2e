"""Structured Streaming over the event log, drained with availableNow so that results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from castline.scratch import new_path


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream over all there is, and return what its sink holds.

    Appended rows go to a Parquet sink, exactly once. A complete result replaces the one before.
    """
    spark = stream.sparkSession
    out, marks = new_path(spark, "stream"), new_path(spark, "marks")
    writer = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def into_batches(stream: DataFrame, path: str, marks: str) -> None:
    """Run the stream over all there is since checkpoint ``marks``; a batch that is run again replaces itself."""
    write = lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")
    stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

