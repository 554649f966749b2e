"""Retrieval over a table of documents with embeddings: hashed embeddings, exact search, two stages, the corpus itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.functions.text import tokens

DIMENSIONS, TRIGRAM_WEIGHT, QUERY_BLOCK, DOCUMENT_BLOCK = 768, 0.35, 512, 4096


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def valid_now(df: DataFrame, now: Column) -> DataFrame:
    """Public documents whose validity interval is open or ends in the future, and has begun."""
    return df.where((F.col("scope") == "public") & (F.col("valid_from") <= now) & (F.col("valid_until").isNull() | (F.col("valid_until") > now)))


def _blocks(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows packed ``size`` at a time where they are: their other columns as lists, and their unit vectors as one matrix.

    A vector that is null, of another length than the first of its block, or without length has no direction and is left out.
    """
    rest = [f for f in rows.schema if f.name != vector]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block() -> pd.DataFrame:
            all_ = pd.concat(held)
            sound = all_[vector].notna()
            all_ = all_[sound]
            width = len(all_[vector].iloc[0]) if len(all_) else 0
            all_ = all_[all_[vector].map(len) == width]
            m = np.array(all_[vector].tolist(), np.float64).reshape(len(all_), width)
            length = np.sqrt((m * m).sum(axis=1))
            good = length > 0
            m = m[good] / length[good, None]
            return pd.DataFrame({**{f.name: [all_[f.name][good].tolist()] for f in rest}, "_m": [m.tobytes()], "_width": [width]})

        for batch in batches:
            for at in range(0, len(batch), size):
                held.append(batch.iloc[at : at + size])
                if sum(map(len, held)) >= size:
                    yield block()
                    held.clear()
        if held:
            yield block()

    schema = ", ".join([*[f"`{f.name}` array<{f.dataType.simpleString()}>" for f in rest], "_m binary, _width int"])
    return rows.mapInPandas(run, schema)


def scored(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_type, key, stage, score: of every query (query_id, q) with documents (doc_type, key, embedding, stage) the pairs
    that may be among the k best of a stage.

    The queries, a stated set, and the documents are packed in blocks; a block of queries meets a block of documents in one
    matrix product, and only the k best of each query and stage (and what ties with them) leave it. A document is no match of itself.
    """
    left = _blocks(docs.select("doc_type", "key", "stage", "embedding"), "embedding", DOCUMENT_BLOCK)
    right = _blocks(queries.select("query_id", F.col("q").alias("q")), "q", QUERY_BLOCK).withColumnsRenamed({"_m": "_q", "_width": "_qw"})
    kinds = {f.name: f.dataType.simpleString() for f in (*docs.schema, *queries.schema)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                if row["_width"] != row["_qw"] or not row["_width"]:
                    continue
                d = np.frombuffer(row["_m"]).reshape(-1, row["_width"])
                q = np.frombuffer(row["_q"]).reshape(-1, row["_qw"])
                if not len(d) or not len(q):
                    continue
                score = np.round(q @ d.T, 9)
                ids, keys, types, stages = (np.array(list(row[c]), object) for c in ("query_id", "key", "doc_type", "stage"))
                score[ids[:, None] == keys[None, :]] = -np.inf
                for stage in dict.fromkeys(stages.tolist()):
                    at = np.flatnonzero(stages == stage)
                    own = score[:, at]
                    least = np.partition(own, -k, axis=1)[:, -k] if own.shape[1] > k else np.full(len(own), -np.inf)
                    i, j = np.nonzero((own >= least[:, None]) & (own > -np.inf))
                    yield pd.DataFrame({"query_id": ids[i], "doc_type": types[at[j]], "key": keys[at[j]], "stage": stage, "score": own[i, j]})

    return left.join(right, how="cross").mapInPandas(run, f"query_id {kinds['query_id']}, doc_type {kinds['doc_type']}, key {kinds['key']}, stage string, score double")


def best(rows: DataFrame, k: int, groups: list[str]) -> DataFrame:
    """The k best of each group with their rank, by score to nine places, then type and key."""
    order = W.partitionBy(*groups).orderBy(F.desc("score"), "doc_type", "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, docs: DataFrame, k: int, types: list[str] | None = None, model: str | None = None, now: Column | None = None) -> DataFrame:
    """query_id, doc_type, key, score, rank: exact cosine top-k, of documents of the given types and model that are valid now."""
    if types:
        docs = docs.where(F.col("doc_type").isin(*types))
    if model:
        docs = docs.where(F.col("model") == model)
    held = (docs if now is None else valid_now(docs, now)).withColumn("stage", F.lit(""))
    return best(scored(queries, held, k), k, ["query_id"]).drop("stage")


def two_stage(queries: DataFrame, docs: DataFrame, stages: dict[str, tuple[list[str], int]]) -> DataFrame:
    """query_id, stage, doc_type, key, score, rank: for each stage the best of its types, in one pass over the documents."""
    stage, most = F.lit(None).cast("string"), F.lit(0)
    for name, (types, k) in stages.items():
        stage = F.when(F.col("doc_type").isin(*types), name).otherwise(stage)
        most = F.when(F.col("stage") == name, k).otherwise(most)
    listed = [x for types, _ in stages.values() for x in types]
    deepest = max(k for _, k in stages.values())
    rows = scored(queries, docs.where(F.col("doc_type").isin(*listed)).withColumn("stage", stage), deepest)
    return best(rows, deepest, ["query_id", "stage"]).where(F.col("rank") <= most)


def features(text: Column) -> Column:
    """Array of (feature, weight): words, pairs of neighbouring words, and the character trigrams of each word with a blank on both sides."""
    ws = tokens(text)
    word = F.transform(ws, lambda w: F.struct(F.concat(F.lit("w:"), w).alias("f"), F.lit(1.0).alias("x")))
    pair = F.transform(F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda w, i: F.struct(F.concat(F.lit("b:"), F.get(ws, i), F.lit("_"), w).alias("f"), F.lit(1.0).alias("x")))
    tri = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.struct(F.concat(F.lit("c:"), F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(3))).alias("f"), F.lit(TRIGRAM_WEIGHT).alias("x")))
    return F.concat(word, pair, F.flatten(F.transform(ws, tri)))


def hash_embed(texts: DataFrame, key: str, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """key, bucket, value: features hashed (md5) to signed buckets, as sparse rows of unit length."""
    each = texts.select(key, F.explode(features(F.col(text))).alias("_f")).groupBy(key, "_f.f", "_f.x").agg(F.count("*").alias("_n"))
    part = lambda at: F.conv(F.substring(F.md5("f"), at, 8), 16, 10).cast("long")
    signed = F.when(part(9) % 2 == 0, F.col("x")).otherwise(-F.col("x")) * F.col("_n")
    sums = each.groupBy(key, (part(1) % dimensions).alias("bucket")).agg(F.sum(signed).alias("value")).where("abs(value) > 1e-9")
    return sums.join(sums.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_l")), key).select(key, "bucket", (F.col("value") / F.col("_l")).alias("value"))


def build_corpus(profiles: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_type, key, title, text, content_sha256: documents on platforms, months and variables from catalogue rows.

    ``counts`` has variable, unit and n. A document's key is stable, and its digest tells whether it has changed.
    """
    month = lambda c: F.date_format(c, "yyyy-MM")
    count = lambda name: F.col(name).cast("string")
    platforms = profiles.groupBy("platform_number").agg(F.count("*").alias("n"), F.min("observed_at").alias("a"), F.max("observed_at").alias("b")).select(
        F.lit("platform").alias("doc_type"), F.col("platform_number").alias("key"), F.concat(F.lit("platform "), "platform_number").alias("title"),
        F.concat(F.lit("Platform "), "platform_number", F.lit(" has "), count("n"), F.lit(" profiles from "), month("a"), F.lit(" to "), month("b"), F.lit(".")).alias("text"),
    )
    months = profiles.groupBy(month("observed_at").alias("key")).agg(F.count("*").alias("n"), F.countDistinct("platform_number").alias("p")).select(
        F.lit("coverage").alias("doc_type"), "key", F.concat(F.lit("coverage "), "key").alias("title"), F.concat(F.lit("In "), "key", F.lit(" there are "), count("n"), F.lit(" profiles of "), count("p"), F.lit(" platforms.")).alias("text")
    )
    parameters = counts.select(
        F.lit("parameter").alias("doc_type"), F.col("variable").alias("key"), F.concat("variable", F.lit(" ("), "unit", F.lit(")")).alias("title"), F.concat(F.lit("Variable "), "variable", F.lit(" in "), "unit", F.lit(" has "), count("n"), F.lit(" values.")).alias("text")
    )
    return platforms.unionByName(months).unionByName(parameters).withColumn("content_sha256", F.sha2(F.concat_ws("\n", "doc_type", "key", "title", "text"), 256))
