"""Retrieval: cosine, exact search, two stages, hashed embeddings, the corpus, held-out questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from castline.functions.qc import VARIABLES
from castline.functions.text import STOP_WORDS, TOKEN
from castline.operators import retrieval
from castline.registry import query, r6
from castline.sinks.writers import UNITS


def _docs(t):
    return t.embeddings.select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("doc_type"), "embedding", F.when(F.col("label") % 4 == 3, "m2").otherwise("m1").alias("model"))


def _queries(t):
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9)"
_PAIRS = f"SELECT q.vec_id AS query_id, CAST(e.label AS VARCHAR) AS doc_type, e.vec_id AS key, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_type, key) AS rank FROM ({pairs})"


@query("rt_cosine", "SELECT label, round(avg(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_transform(embedding, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END) AS DOUBLE[]))) + 1e-9, 6) AS mean FROM embeddings GROUP BY label")
def _(t):
    half = F.transform("embedding", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0).cast("float")))
    return t.embeddings.select("label", retrieval.cosine(F.col("embedding"), half).alias("c")).groupBy("label").agg(r6(F.avg("c"), "mean"))


@query("top_cosine", f"SELECT query_id, doc_type, key, rank FROM ({_RANKED.format(by='query_id', pairs=_PAIRS)}) WHERE rank <= 10")
def _(t):
    return retrieval.search(_queries(t), _docs(t), 10).select("query_id", "doc_type", "key", "rank")


@query("rt_search", f"SELECT query_id, doc_type, key, rank, round(score, 5) AS score FROM ({_RANKED.format(by='query_id', pairs=_PAIRS + ' AND e.label % 4 <> 3 AND e.label < 8')}) WHERE rank <= 5")
def _(t):
    """Of one model and some types only."""
    found = retrieval.search(_queries(t), _docs(t), 5, types=[str(k) for k in range(8)], model="m1")
    return found.select("query_id", "doc_type", "key", "rank", F.round("score", 5).alias("score"))


@query("rt_two_stage", f"SELECT query_id, stage, doc_type, key, rank FROM ({_RANKED.format(by='query_id, stage', pairs=f'SELECT *, CASE WHEN CAST(doc_type AS INT) < 5 THEN {chr(39)}context{chr(39)} ELSE {chr(39)}example{chr(39)} END AS stage FROM ({_PAIRS})')}) WHERE rank <= CASE stage WHEN 'context' THEN 6 ELSE 3 END")
def _(t):
    labels = [str(k) for k in range(100)]
    found = retrieval.two_stage(_queries(t), _docs(t), {"context": (labels[:5], 6), "example": (labels[5:], 3)})
    return found.select("query_id", "stage", "doc_type", "key", "rank")


_FEATURES = f"""WITH d AS (SELECT conv_id * 1000 + turn AS k, list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda x: x NOT IN {STOP_WORDS}) AS ws FROM conversations WHERE role = 'user' AND NOT regexp_matches(text, '[^\\x00-\\x7F]')),
 w AS (SELECT k, 'w:' || unnest(ws) AS f, 1e0 AS x FROM d), b AS (SELECT k, 'b:' || ws[i] || '_' || ws[i + 1] AS f, 1e0 AS x FROM (SELECT k, ws, unnest(range(1, greatest(len(ws), 1))) AS i FROM d)),
 c AS (SELECT k, 'c:' || substr(' ' || w || ' ', i, 3) AS f, 0.35e0 AS x FROM (SELECT k, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT k, unnest(ws) AS w FROM d))),
 a AS (SELECT * FROM w UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
 s AS (SELECT k, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 768 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(f), 9, 8) AS BIGINT) % 2 = 0 THEN x ELSE -x END) AS v FROM a GROUP BY 1, 2 HAVING abs(v) > 1e-9)
 SELECT k, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY k)), 5) AS value FROM s"""


@query("rt_hash_embed", _FEATURES)
def _(t):
    """Users' turns in ASCII as sparse unit vectors."""
    users = t.conversations.where("role = 'user'").where(~F.col("text").rlike(r"[^\x00-\x7F]")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return retrieval.hash_embed(users, "k").withColumn("value", F.round("value", 5))


@query("rt_corpus", f"""WITH d AS (SELECT 'platform' AS doc_type, platform_number AS key, 'platform ' || platform_number AS title, 'Platform ' || platform_number || ' has ' || count(*) || ' profiles from ' || strftime(min(observed_at), '%Y-%m') || ' to ' || strftime(max(observed_at), '%Y-%m') || '.' AS text FROM b_profiles GROUP BY platform_number
 UNION ALL SELECT 'coverage', m, 'coverage ' || m, 'In ' || m || ' there are ' || n || ' profiles of ' || p || ' platforms.' FROM (SELECT strftime(observed_at, '%Y-%m') AS m, count(*) AS n, count(DISTINCT platform_number) AS p FROM b_profiles GROUP BY 1)
 UNION ALL {' UNION ALL '.join(f"SELECT 'parameter', '{v}', '{v} ({UNITS[v]})', 'Variable {v} in {UNITS[v]} has ' || count({v[0]}) || ' values.' FROM b_sel" for v in VARIABLES)})
 SELECT *, sha256(doc_type || chr(10) || key || chr(10) || title || chr(10) || text) AS content_sha256 FROM d""")
def _(t):
    counts = t.selected().agg(*[F.count(v[0]).alias(v) for v in VARIABLES])
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(UNITS[v]).alias("unit"), F.col(v).alias("n")) for v in VARIABLES])).alias("x")
    return retrieval.build_corpus(t.profiles, counts.select(rows).select("x.*"))


@query("rt_holdout", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM conversations WHERE role = 'user' AND conv_id % 2 = 0)")
def _(t):
    norm = lambda df: df.withColumn("norm", F.lower(F.trim("text")))
    users = norm(t.conversations.where("role = 'user'"))
    return users.join(users.where("conv_id % 2 = 0").select("norm"), "norm", "left_anti").select("conv_id", "turn")
