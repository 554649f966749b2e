"""Exact dedup over an extendible-hash index on shared files.

1. Texts are grouped by their 64-bit key and their own bytes, folded in each task before the shuffle, so
   a text that a third of the rows share crosses the network once a task. Each group is a link: its
   count and its last row. Links of one key form the key's chain.
2. ``directory`` starts with one bucket and doubles: a bucket with more keys than ``capacity`` is split on
   the next bit of the key, until none is overfull. Keys differ, so this ends at 64 bits at the latest.
   The directory grows as keys / capacity; it is broadcast while it has under BROADCAST_BUCKETS buckets.
3. The index is written to the shared folder in ranges of (bucket, key), one owner task for each.
4. A row finds its bucket in the directory and its chain in the bucket. In a chain of one link all bytes
   are equal, as they were grouped by them. In a longer chain the row goes to the link whose bytes are
   its own, byte by byte.

Defined results: a null text counts as empty; a null doc_id sorts below every other; of repeated rows
(same doc_id and text) one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import documents, stored

#: Keys of a bucket at most: what one owner task sorts with its bucket's neighbours, well under a megabyte of entries.
CAPACITY, STEP = 1 << 12, 14
BROADCAST_BUCKETS = 1 << 20


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key ``h``."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(depth, bucket): the leaves; a bucket is named by its depth and that many first bits of its keys ``h``.

    Keys are counted by STEP bits more in one pass, and doubling goes on over these counts; only buckets
    that are overfull even then are counted again.
    """
    leaves, open_, at = [], keys.select("h"), 0
    while True:
        finest = min(64, at + STEP)
        fine = stored(open_.groupBy(_prefix(finest).alias("fine")).agg(F.count("*").alias("n")), "directory")
        for depth in range(at, finest + 1):
            size = fine.groupBy(F.expr(f"shiftrightunsigned(fine, {finest - depth})").alias("bucket")).agg(F.sum("n").alias("n"))
            size = stored(size, "directory")
            leaves.append(size.where(F.col("n") <= capacity).select(F.lit(depth).alias("depth"), "bucket"))
            overfull = size.where(F.col("n") > capacity).select("bucket")
            if overfull.isEmpty():
                return stored(_union(leaves), "directory")
            up = F.expr(f"shiftrightunsigned(fine, {finest - depth})")
            fine = fine.withColumn("bucket", up).join(overfull, "bucket", "left_semi").select("fine", "n")
        if finest == 64:
            raise ValueError("capacity must be 1 or more")
        open_ = open_.withColumn("bucket", _prefix(finest)).join(overfull, "bucket", "left_semi").select("h")
        at = finest


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def placed(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the depth and bucket of their key ``h``: one lookup for each depth that has leaves (64 at most)."""
    near = F.broadcast if leaves.count() <= BROADCAST_BUCKETS else (lambda x: x)
    for d in sorted(r["depth"] for r in leaves.select("depth").distinct().collect()):
        level = leaves.where(F.col("depth") == d).select(F.col("bucket").alias(f"_b{d}"))
        rows = rows.join(near(level), _prefix(d) == F.col(f"_b{d}"), "left")
    found = [c for c in rows.columns if c.startswith("_b")]
    depth = F.coalesce(*[F.when(F.col(c).isNotNull(), int(c[2:])) for c in found]) if found else F.lit(0)
    bucket = F.coalesce(*found) if found else F.lit(0).cast("long")
    return rows.withColumns({"depth": depth, "bucket": bucket}).drop(*found)


def dedup(docs: DataFrame, key: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, depth: one row for each row of ``docs``.

    ``key`` is a 64-bit hash of the column ``text`` (xxhash64); a weaker one only makes longer chains.
    """
    key = F.xxhash64("text") if key is None else key
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", key)
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    light = stored(texts.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "h", sha), "rows")
    # Chains: how many links a key has. Only keys with several need their bytes again.
    links = texts.groupBy("h", "text").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("links"), F.sum("n").alias("n"))
    chains = stored(links, "chains")
    leaves = directory(chains, capacity)
    last = F.max(F.struct("doc_id", "tag")).alias("last")
    entries = chains.join(light.groupBy("h").agg(last), "h")
    index = stored(placed(entries, leaves).repartitionByRange("depth", "bucket", "h").sortWithinPartitions("depth", "bucket", "h"), "index")
    found = placed(light, leaves).join(index, ["depth", "bucket", "h"]).where("links = 1").drop("links")
    several = stored(index.where("links > 1").select("h"), "several")
    if not several.isEmpty():
        # Rows of these keys take their bytes along, and are told apart by them alone.
        tagged = texts.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "h", "text", sha)
        held = stored(tagged.join(several, "h", "left_semi"), "held")
        own = held.groupBy("h", "text").agg(F.count("*").alias("n"), last)
        found = found.unionByName(placed(held, leaves).join(own, ["h", "text"]).drop("text"))
    return found.select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("last.tag") == F.col("tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "depth",
    )


def op5_exact_dedup(spark, sf_dir):
    return dedup(documents(spark, sf_dir)).drop("bucket", "depth")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
