"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact checks.

1. One pass over the texts gives each row its set size, a 128-bit hash of its shingle set, and the
   bucket keys of its bands. One permutation fills BINS bins; empty bins are filled by optimal
   densification (each probes bins by its own hash sequence until it meets a filled one).
2. Rows with equal sets are one node, pre-aggregated before the shuffle; only nodes are compared.
3. In each bucket the node that meets most others in its buckets is the star's centre. Every node is first checked against one
   centre, then against the centres that it is not yet connected with.
4. Buckets whose nodes are still not all connected are finished exactly: their pairs across different
   components are checked, so no candidate pair stays unchecked unless it is already connected.
5. Links are confirmed on the full shingle sets: 100 * intersection >= percent * union.

A pair at similarity 0.8 shares no band with a probability of about (1 - 0.8**4)**32 = 5e-8.

Defined results: a text without words has an empty set and is linked with nothing; rows with equal
sets, repeated rows included, are in one component; rows are told apart by a row number, so that those
without a doc_id, or with the same one, have verdicts of their own; a null doc_id never is a component's
id unless all its rows have none (``kept`` is then false); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import documents, numbered, stored, texts_of
from llm.components import components
from llm.shingles import WordHashes, mix, shingle_set

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
PARITY_BITS = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted non-empty set, densified."""
    bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    at, first = np.unique(bins, return_index=True)  # the set is sorted: a bin's first is its least
    sig, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[at], filled[at] = hashes[first], True
    empty, attempt = np.flatnonzero(~filled), 1
    while len(empty):
        probe = (mix(empty.astype(np.uint64) * _ODD + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        hit = filled[probe]
        sig[empty[hit]] = sig[probe[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return sig


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * _ODD + rows[:, j])
    return key.view(np.int64)


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    return int(np.bitwise_xor.reduce(mix(hashes + _ODD)).view(np.int64)), int(mix(hashes).sum(dtype=np.uint64).view(np.int64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits: whether an odd number of the set's hashes fall on each.

    Elements in both of two sets cancel out, so the exclusive-or of their parities has at most as many
    bits as elements that only one of them has: a bound on the similarity that never errs.
    """
    at = (mix(hashes ^ _ODD) % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def sketches(texts: DataFrame, size: int) -> DataFrame:
    """tag, doc_id, n, s1, s2, buckets: a row for each (tag, doc_id, text), written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            out = []
            for text in b["text"]:
                s = shingle_set(text, size, cache)
                out.append((len(s), *set_hash(s), bucket_keys(signature(s)).tolist()) if len(s) else (0, 0, 0, []))
            yield pd.concat([b[["tag", "doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n", "s1", "s2", "buckets"])], axis=1)

    kind = dict(texts.dtypes)["doc_id"]
    rows = texts.select("tag", F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = rows.mapInPandas(run, "tag long, doc_id string, n long, s1 long, s2 long, buckets array<long>")
    return stored(made.withColumn("doc_id", F.col("doc_id").cast(kind)), "sketches")


def node_sets(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, set, odd) of the given nodes (node), from the texts of their rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            out = []
            for node, text in zip(b["node"], b["text"], strict=True):
                s = shingle_set(text, size, cache)
                out.append((node, s.tobytes(), parities(s)))
            yield pd.DataFrame(out, columns=["node", "set", "odd"])

    found = nodes.join(texts.select(F.col("tag").alias("node"), "text"), "node")
    return stored(found.mapInPandas(run, "node long, set binary, odd array<long>"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["a"], b["b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[keep, ["u", "v"]]

    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("a")), sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    full = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return full.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    return verdicts(texts_of(numbered(docs)), size, percent).drop("tag", "first")


def verdicts(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """tag, doc_id, n_shingles, component_id, kept, first: one row for each (tag, doc_id, text).

    ``first`` is the tag of the component's first row, by doc_id (rows without one last) and tag; null for a text without words.
    """
    rows = sketches(texts, size)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("least")
    nodes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("tag").alias("node"), least)
    nodes = stored(nodes, "nodes")
    keyed = rows.join(nodes.select(F.col("node").alias("tag")), "tag").select(F.col("tag").alias("node"), "n", F.explode("buckets").alias("bucket"))
    # A group of near copies has a text that the others were made from: it meets more of them than they
    # meet one another. So a bucket's centre is the node that shares its buckets with most others.
    held = keyed.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    crowded = stored(keyed.join(held, "bucket"), "crowded")
    rank = crowded.groupBy("node").agg(F.sum("held").alias("rank"))
    ranked = crowded.join(rank, "node").select("bucket", "node", "n", F.struct(F.col("rank"), (-F.col("node")).alias("at"), "n").alias("place"))
    ranked = stored(ranked, "ranked")
    centre = ranked.groupBy("bucket").agg(F.max("place").alias("top"))
    members = stored(ranked.join(centre, "bucket").select("bucket", "node", "n", (-F.col("top.at")).alias("centre"), F.col("top.n").alias("centre_n"), F.col("top.rank").alias("rank")), "members")
    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)  # noqa: E731  sizes that allow the similarity
    edges = stored(
        members.where((F.col("node") != F.col("centre")) & alike("n", "centre_n"))
        .groupBy(F.col("node").alias("v"), F.col("centre").alias("u")).agg(F.max("rank").alias("rank")),
        "edges",
    )
    sets = node_sets(texts, members.select("node").distinct(), size)

    def joined(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs with the component of both ends; a node without links is its own."""
        a, b = label.select(F.col("u"), F.col("component").alias("cu")), label.select(F.col("u").alias("v"), F.col("component").alias("cv"))
        return pairs.join(a, "u", "left").join(b, "v", "left").withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")})

    # Each node's first centre, then the centres it isn't connected with yet.
    first = edges.groupBy("v").agg(F.max_by("u", F.struct("rank", "u")).alias("u")).select("u", "v")
    links = stored(confirmed(first, sets, percent), "links")
    label = stored(components(links), "label")
    rest = joined(edges.join(first, ["u", "v"], "left_anti"), label).where("cu <> cv").select("u", "v")
    links = links.unionByName(stored(confirmed(rest, sets, percent), "links"))
    label = stored(components(links), "label")
    # Buckets whose nodes aren't all connected: the pairs across components that no star has checked.
    here = members.join(label.select(F.col("u").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = here.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    odd = sets.select("node", "odd")
    open_ = stored(here.join(mixed, "bucket").where("node <> centre").select("bucket", "node", "n", "component").join(odd, "node"), "open")
    if not open_.isEmpty():
        # Most pairs that only share a passage end here, at the bound on what one of them alone has.
        words = range(PARITY_BITS // 64)
        side = lambda k: open_.select("bucket", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("component").alias(f"c{k}"), *[F.col("odd")[i].alias(f"{k}{i}") for i in words])
        apart = sum((F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in words[1:]), F.bit_count(F.col("u0").bitwiseXOR(F.col("v0"))))
        near = (100 + percent) * apart <= (100 - percent) * (F.col("nu") + F.col("nv"))
        pairs = side("u").join(side("v"), "bucket").where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & alike("nu", "nv") & near)
        pairs = pairs.groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")
        more = stored(confirmed(pairs, sets, percent), "links")
        if not more.isEmpty():
            label = stored(components(links.unionByName(more)), "label")
    named = nodes.join(label.select(F.col("u").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("least"))
    named = named.drop("least").join(ids, "component").select("s1", "s2", "n", F.col("least.doc_id").alias("component_id"), F.col("least.tag").alias("first"))
    out = rows.join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return out.select("tag", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "first")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that follow the first of their component.

    Rows without a doc_id follow those with one. Texts without words are linked with nothing and all stay.
    """
    rows = numbered(docs)
    gone = stored(verdicts(texts_of(rows), size, percent).where("tag <> first").select("tag"), "gone").hint("merge")
    return rows.join(gone, "tag", "left_anti").select("_row.*")


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), size=2, percent=80)


OP10_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i+1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS MATERIALIZED (SELECT g, count(*) AS f FROM s GROUP BY g),
k AS MATERIALIZED (SELECT doc_id, g FROM (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.g) AS r FROM s JOIN f USING (g) JOIN n USING (doc_id)) WHERE r <= n - ceil(0.8 * n) + 1),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id),
p AS MATERIALIZED (SELECT x, y, count(*) AS shared FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g GROUP BY x, y),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
z AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, z.y FROM r JOIN z ON z.x = r.to_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(to_id) AS component_id, r.doc_id = min(to_id) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
