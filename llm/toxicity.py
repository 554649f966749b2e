"""Toxicity from subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed character n-grams (3 to 5 bytes, its ends included)
and of nothing else, so a misspelling that training never saw shares most vectors with its neighbours.
The softmax sees words, and a text is as toxic as its most toxic word: a few toxic words in a long text
are not averaged away. In training a text's words are pooled with weights that sharpen towards the
largest, and in every epoch a share of the n-grams is left out, so that no single one carries a word.

The model is fitted on a bounded sample of rows: at most ``rows`` labelled rows of label 1 and of label
0 (those with the least hash of doc_id), whole texts and all their words. The share of each class among
all labelled training rows then sets the bias. The model has a fixed size (BUCKETS x DIM), so it is
broadcast. Every whole text is scored.

Defined results: null and blank texts get the score of a word without n-grams; without labels of both
classes every score is the smoothed share of label 1; labels that repeat count once, by majority; a
null doc_id is not held out and has no label; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import documents

BUCKETS, DIM = 1 << 16, 8
SIZES = (3, 4, 5)
ROWS_TOXIC, ROWS_OTHER = 1500, 3000
EPOCHS, RATE, DECAY, DROPPED, SHARPNESS = 60, 0.05, 1e-5, 0.3, 4.0
THRESHOLD = 0.7


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def subwords(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, number of its word), word by word; a word has at least one."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in ws), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    word = np.repeat(np.arange(len(ws)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))  # bytes to the end of the word
    owner, bucket, h = [], [], np.zeros(len(raw), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h[: len(raw) - n + 1] = (h[: len(raw) - n + 1] + raw[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            ok = np.flatnonzero(left >= n)
            owner.append(word[ok])
            bucket.append((h[ok] >> np.uint64(20)) % np.uint64(BUCKETS))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


@dataclass
class Bags:
    """Texts as bags of distinct words, words as bags of n-grams; texts without words are left out."""

    flat: np.ndarray  # the words of each text, text by text
    size: np.ndarray  # how many words each text has
    sub: np.ndarray
    owner: np.ndarray
    n_words: int

    @classmethod
    def of(cls, texts: list[str | None]) -> tuple[Bags, np.ndarray]:
        """(bags, which texts they are)."""
        each = [sorted(set(words(t))) for t in texts]
        ids = {w: k for k, w in enumerate(sorted(set().union(*each)))}
        at = np.flatnonzero([bool(ws) for ws in each])
        size = np.array([len(each[k]) for k in at], np.int64)
        flat = np.fromiter((ids[w] for k in at for w in each[k]), np.int64, size.sum())
        sub, owner = subwords(list(ids)) if ids else (np.empty(0, np.int64),) * 2
        return cls(flat, size, sub, owner, len(ids)), at


def step(emb: np.ndarray, w: np.ndarray, bias: np.ndarray, bags: Bags, y: np.ndarray, live: np.ndarray, sharp: float):
    """Gradients of the mean log loss by (emb, w, bias), with the pooling weights held.

    ``live`` marks the n-grams that take part. The softmax is linear, so a word's margin is the mean of
    its n-grams' margins, and the sums over n-grams need one number each instead of a vector.
    """
    apart = w[:, 1] - w[:, 0]
    n_live = np.maximum(np.bincount(bags.owner, live, bags.n_words), 1)
    margin = np.bincount(bags.owner, (emb @ apart)[bags.sub] * live, bags.n_words) / n_live + bias[1] - bias[0]
    first = np.cumsum(bags.size) - bags.size
    m = margin[bags.flat]
    a = np.exp(sharp * (m - np.repeat(np.maximum.reduceat(m, first), bags.size)))
    a /= np.repeat(np.add.reduceat(a, first), bags.size)
    pooled = np.add.reduceat(a * m, first)
    err = (1 / (1 + np.exp(-np.clip(pooled, -40, 40))) - y) / len(y)
    by_word = np.bincount(bags.flat, a * np.repeat(err, bags.size), bags.n_words)
    by_gram = np.bincount(bags.sub, (by_word / n_live)[bags.owner] * live, BUCKETS)
    gw = emb.T @ by_gram
    return np.outer(by_gram, apart), np.stack([-gw, gw], axis=1), np.array([-by_word.sum(), by_word.sum()])


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, decay: float = DECAY, seed: int = 3):
    """(embeddings, weights, bias): full-batch Adam on embeddings and softmax together."""
    bags, at = Bags.of(texts)
    if not len(at):
        return np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2)), np.zeros(2)
    y, rng = np.asarray(labels, np.float64)[at], np.random.default_rng(seed)
    emb, w, bias = np.zeros((BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    seen = np.unique(bags.sub)
    emb[seen] = rng.normal(0, 0.1, (len(seen), DIM))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, w, bias)]
    for epoch in range(epochs):
        live = (rng.random(len(bags.sub), np.float32) >= DROPPED).astype(np.float64)
        ge, gw, gb = step(emb, w, bias, bags, y, live, SHARPNESS * (epoch + 1) / epochs)
        for k, (x, d) in enumerate(((emb, ge + decay * emb), (w, gw + decay * w), (bias, gb))):
            m, v = state[k]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= RATE * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    return emb.astype(np.float32), w, bias


class Scorer:
    """Scores whole texts: the linear softmax makes a word one number, kept while met."""

    def __init__(self, emb: np.ndarray, w: np.ndarray, bias: np.ndarray, shift: float):
        self.table = (emb @ (w[:, 1] - w[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0]) + shift
        self.known: dict[bytes, float] = {}

    def learn(self, ws: set[bytes]) -> None:
        new = [w for w in ws if w not in self.known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            sub, owner = subwords(part)
            values = np.bincount(owner, self.table[sub], len(part)) / np.bincount(owner, minlength=len(part))
            self.known.update(zip(part, values.tolist(), strict=True))

    def __call__(self, texts: list[list[bytes]]) -> list[float]:
        if len(self.known) > 500_000:
            self.known.clear()
        each = [set(ws) for ws in texts]
        self.learn(set().union(*each))
        value = self.known.__getitem__
        z = np.array([max(map(value, ws), default=0.0) for ws in each]) + self.bias
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def held_out(doc_id: Column, modulus: int = 3) -> Column:
    """crc32 of doc_id as text leaves remainder 1; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = (ROWS_TOXIC, ROWS_OTHER)):
    """(model bytes or None, share of label 1 among the labelled training rows)."""
    gold = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
        .where(~held_out(F.col("doc_id")))
    )
    share = {r["y"]: r["n"] for r in gold.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (share.get(1, 0) + 1) / (sum(share.values()) + 2)
    if len(share) < 2:
        return None, prior
    order = F.xxhash64("doc_id")
    picked = gold.where("y = 1").orderBy(order, "doc_id").limit(rows[0]).unionByName(gold.where("y = 0").orderBy(order, "doc_id").limit(rows[1]))
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # Of rows that share a doc_id the text of least hash stands for it, however the rows are dealt.
    sample = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_least"), F.first("y").alias("y")).select("doc_id", F.col("_least.text").alias("text"), "y")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"doc_id": [], "text": [], "y": []})]).sort_values("doc_id")
        got = got[got["text"].fillna("").str.strip() != ""]
        y = got["y"].to_numpy()
        if len(np.unique(y)) < 2:
            return
        emb, w, bias = fit(list(got["text"]), y)
        np.savez(out := io.BytesIO(), emb=emb, w=w, bias=bias, odds=np.log((y == 1).sum() / (y == 0).sum()))
        yield pd.DataFrame({"model": [out.getvalue()]})

    made = sample.select("doc_id", "text", "y").repartition(1).mapInPandas(train, "model binary").collect()
    return (bytes(made[0]["model"]) if made else None), prior


def toxicity(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = (ROWS_TOXIC, ROWS_OTHER)) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    model, prior = trained(docs, labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast((model, prior))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw, share = sent.value
        if raw is None:
            for b in batches:
                yield pd.Series([share] * len(b))
            return
        m = np.load(io.BytesIO(raw))
        scorer = Scorer(m["emb"], m["w"], m["bias"], float(np.log(share / (1 - share)) - m["odds"]))
        for b in batches:
            yield pd.Series(np.concatenate([scorer([words(t) for t in b.iloc[i : i + 500]]) for i in range(0, len(b), 500)]) if len(b) else [], dtype="float64")

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
