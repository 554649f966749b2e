"""Helpers that several operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castline.scratch import new_path

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at a table that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame) -> None:
    """Take the rows of a ``stored`` table that nothing reads any more off the shared folder."""
    if files := df.inputFiles():
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``_row``, so that no column of the input can clash with a working column."""
    return docs.select(F.struct("*").alias("_row"))


def numbered(docs: DataFrame) -> DataFrame:
    """tag, ``_row``: each row with a number of its own, written once, so that what is found of a row goes back to it whatever its doc_id."""
    return stored(packed(docs).select(F.monotonically_increasing_id().alias("tag"), "_row"), "numbered")


def texts_of(rows: DataFrame) -> DataFrame:
    """tag, doc_id, text of numbered rows."""
    return rows.select("tag", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))


def words_of(text: Column) -> Column:
    """Words ``[^\x20\x09-\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def released(spark: SparkSession) -> None:
    """Have the driver forget finished steps, so that Spark removes their shuffle files before the next large one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
