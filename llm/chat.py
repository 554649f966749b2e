"""Chat formatting of logged conversations, with cumulative snapshots collapsed.

A log often holds a conversation several times, each time with a few more turns. Turns get their place
in the conversation, and every prefix a 128-bit hash: the exclusive-or of the hashes of its turns, each
hashed with its place, so it rolls on from turn to turn. A conversation whose whole hash and length are
those of a proper prefix of another is a snapshot of it, and an anti-join drops it; of conversations
that are equal throughout, the one with the least conv_id stays. Only the conversations that remain
are rendered.

Places and prefix hashes are running figures of a sorted table that is cut into blocks of rows: a
window runs within a block, and sums over a conversation's blocks carry them on. So no task holds a
conversation whole, however long it is.

A conversation is rendered as one text. ``turns_per_part`` gives it in parts of so many turns instead,
for conversations too long for one row; the parts joined in order are the same text.

What a role or text holds cannot pass for a marker: each ``<|`` in it is written ``<||``, and reading
``<||`` back as ``<|`` gives the original.

Defined results: turns are ordered by turn, then role and text, nulls first; repeated rows are turns
of their own; a null role is ``user``, a null text is empty; rows without a conv_id are one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import stored

# The markers of the rendered form.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Turns that are joined at a time on the way to the whole text.
TURNS_AT_ONCE = 64


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, h1, h2: h1 and h2 hash the conversation's prefix up to the turn."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    blocks = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()), "turns")

    def carried(df: DataFrame, sums: list[Column], names: list[str], carry) -> DataFrame:
        """Adds to each row what the conversation's earlier blocks hold."""
        parts = df.groupBy("conv_id", "block").agg(*[s.alias(n) for s, n in zip(sums, names, strict=True)])
        before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *[F.coalesce(carry(n).over(before), F.lit(0)).alias(f"_{n}") for n in names])
        return df.join(parts, df["conv_id"].eqNullSafe(F.col("_c")) & (df["block"] == F.col("_b"))).drop("_c", "_b")

    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rolling = W.partitionBy("conv_id", "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    at = carried(blocks.withColumn("own", F.row_number().over(inside)), [F.count("*")], ["n"], F.sum)
    at = at.withColumn("place", F.col("own") + F.col("_n"))
    for k, h in ((1, "x1"), (2, "x2")):
        at = at.withColumn(h, F.xxhash64(F.lit(k), "place", "role", "text"))
    at = at.select("conv_id", "block", "place", "role", "text", "x1", "x2")
    rolled = carried(at, [F.bit_xor("x1"), F.bit_xor("x2")], ["p1", "p2"], F.bit_xor)
    return rolled.select(
        "conv_id", "place", "role", "text",
        F.bit_xor("x1").over(rolling).bitwiseXOR(F.col("_p1")).alias("h1"),
        F.bit_xor("x2").over(rolling).bitwiseXOR(F.col("_p2")).alias("h2"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no prefix of a longer one."""
    ends = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    marked = prefixes.select("conv_id", "place", "h1", "h2").join(ends.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
    whole = marked.where(F.col("place") == F.col("n_turns")).groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = marked.where(F.col("place") < F.col("n_turns")).select("place", "h1", "h2").distinct()
    return whole.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def _joined(rows: DataFrame, by: list[str], place: str, piece: str) -> DataFrame:
    """``by``, n_turns, n_copies, piece: the pieces of each group in the order of ``place``."""
    made = rows.groupBy(*by).agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct(place, piece))).alias("_p"))
    return made.select(*by, "n_turns", "n_copies", F.array_join(F.transform("_p", lambda x: x[piece]), "").alias("piece"))


def rendered(turns: DataFrame, turns_per_part: int | None = None) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations, whole.

    With ``turns_per_part`` also part, from 0, and ``rendered`` is the part's.
    """
    prefixes = stored(placed(turns), "prefixes")
    kept = maximal(prefixes).withColumnRenamed("conv_id", "_c")
    piece = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE), escaped(F.col("text")), F.lit(CLOSE)).alias("piece")
    rows = prefixes.join(kept, prefixes["conv_id"].eqNullSafe(F.col("_c"))).select(
        "conv_id", F.floor((F.col("place") - 1) / (turns_per_part or TURNS_AT_ONCE)).cast("long").alias("part"), "place", "n_turns", "n_copies", piece
    )
    parts = _joined(rows, ["conv_id", "part"], "place", "piece")
    return (parts if turns_per_part else _joined(parts, ["conv_id"], "part", "piece")).withColumnRenamed("piece", "rendered")


def op8_chat(spark, sf_dir):
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = """
WITH p AS (SELECT conv_id, turn, row_number() OVER w AS place, string_agg('<|im_start|>' || replace(coalesce(role, 'user'), '<|', '<||') || chr(10) || replace(coalesce(text, ''), '<|', '<||') || '<|im_end|>' || chr(10), '') OVER w AS prefix
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
n AS (SELECT conv_id, max(place) AS n_turns FROM p GROUP BY conv_id),
m AS (SELECT p.*, n_turns FROM p JOIN n USING (conv_id)),
f AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM m WHERE place = n_turns GROUP BY prefix, n_turns)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, n_copies, prefix AS rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.place < m.n_turns AND m.place = f.n_turns AND m.prefix = f.prefix)
"""
