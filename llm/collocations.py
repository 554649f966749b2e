r"""Phrase collocations by prefix-free parsing: n-grams are counted in a dictionary of chunks, not in the texts.

A-Z are lower-cased; ``[.,;:!?\x0A-\x0D]`` end pieces, and the words ``[^\x20\x09]+`` of a piece make its phrases.

1. ``parsed``: where the rolling hash of two neighbouring words is a multiple of TRIGGER, a chunk ends with these
   words and the next one begins with them. Equal passages are cut alike wherever they stand. ``dictionary``
   holds each distinct chunk of a language once, with its frequency in the parse.
2. ``grams`` counts words, pairs and triples inside distinct chunks, weighted by frequency. Chunks overlap by two
   words, so a phrase of up to three words lies whole in the chunk in which it starts; what starts in a chunk's last two
   words is counted in the next one. A text's last chunk ends with a line feed and counts all.
3. A pair can only be frequent if its words are, a triple only if its pairs are. What is frequent is marked in a
   filter of FILTER_BITS bits, a fixed size whatever the corpus, and only what its parts are marked for leaves a task. A filter
   that fills up lets more through; counts stay exact, as they are made of words and not of hashes.
4. ``collocations`` joins each candidate's cuts to the counts of their parts. A score is a quotient of integers of
   up to 38 digits. Ranks are taken among the first of each of SPREAD parts of a language.

Defined results: a null or empty text has no words; a null lang is ``und``; repeated rows count each time;
an empty table gives an empty result; columns beside lang and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import documents, released, stored
from llm.shingles import mix

TRIGGER = 16
FILTER_BITS = 1 << 26
LEAST, INSIDE_PERCENT, TOP, SPREAD = 10, 50, 2000, 64
#: Bytes of text that are worked on at once, and bytes that are hashed at once.
BLOCK, STRETCH = 4 << 20, 1 << 20

_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
_LOW[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10
_LOW[9] = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Words:
    """The words of lower-cased bytes that end with a blank or a line feed.

    ``data`` has one blank after each word; word k is data[at[k]:at[k + 1] - 1]. ``ends`` tells whether a piece
    ends after it, ``place`` where it began before.
    """

    def __init__(self, low: np.ndarray):
        blank = (low == 32) | (low == 10)
        before = np.concatenate(([True], blank[:-1]))
        self.place, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        feeds = np.cumsum(low == 10)
        until = np.append(self.place[1:], len(low))
        self.ends = feeds[until - 1] > feeds[end - 1] if len(end) else np.empty(0, bool)
        self.data = low[~blank | (blank & ~before)]
        self.at = np.concatenate(([0], np.cumsum(end - self.place + 1)))
        self.data[self.at[1:] - 1] = 32

    def __len__(self) -> int:
        return len(self.place)

    def hashes(self) -> np.ndarray:
        """A 64-bit rolling hash of each word's bytes, made STRETCH bytes at a time. It marks triggers and filter bits and stands for no word."""
        cuts = np.unique(np.append(np.searchsorted(self.at, np.arange(0, len(self.data), STRETCH)), len(self)))
        return np.concatenate([np.empty(0, np.uint64), *[self._hashes(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]])

    def _hashes(self, a: int, b: int) -> np.ndarray:
        data, at = self.data[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a]
        power, back = np.cumprod(np.full(len(data), _BASE)), np.cumprod(np.full(len(data), _INVERSE))
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
        return mix((sums[at[1:] - 1] - sums[at[:-1]]) * back[at[:-1]])

    def strings(self) -> pa.Array:
        """The words, each with the blank after it, over the bytes as they are."""
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.data)])


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BLOCK bytes of ``column``."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // BLOCK, prepend=-1, append=-1)) if len(size) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def parsed(docs: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """lang, chunk: the parse of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, "text"):
            texts = rows["text"].cast(pa.binary()).to_pylist()
            low = _LOW[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
            ends = np.cumsum([len(t) + 1 for t in texts])
            words = Words(low)
            if not len(words):
                continue
            doc = np.searchsorted(ends, words.place, side="right")
            h = words.hashes()
            last = np.append(doc[1:] != doc[:-1], True)
            cut = (mix(h[:-1] * _BASE + h[1:]) % np.uint64(trigger) == 0) & ~last[:-1]
            first = np.flatnonzero(np.append(cut, False) | np.concatenate(([True], last[:-1])))
            following = np.append(first[1:], len(words))
            closing = last[following - 1]  # the text's last chunk has no overlap after it, and keeps a line feed
            stop = words.at[np.where(closing, following, np.minimum(following + 2, len(words)))] - np.where(closing, 0, 1)
            words.data[words.at[1:] - 1] = np.where(words.ends, 10, 32)
            data = words.data.tobytes()
            chunks = [data[a:b] for a, b in zip(words.at[first].tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows["lang"].take(pa.array(doc[first])), pa.array(chunks, pa.binary()).cast(pa.string())], ["lang", "chunk"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.where("text <> ''").mapInArrow(run, "lang string, chunk string")


def dictionary(docs: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """lang, chunk, n: the distinct chunks and how often the parse has them."""
    return stored(parsed(docs, trigger).groupBy("lang", "chunk").agg(F.count("*").alias("n")), "chunks")


def _key(lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """A filter key of phrases, from the hashes of their language and words."""
    found = lang
    for h in words:
        found = mix(found * _BASE + h)
    return found % np.uint64(FILTER_BITS)


def _marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (bits[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63))) & np.uint64(1) != 0


def _feed(strings: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n".join([*strings, b""]), np.uint8)


def _langs(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct languages, the hash of each, and the place of each row's among them."""
    held = column.dictionary_encode()
    hashes = [int(np.bitwise_xor.reduce(np.append(Words(_feed([x.encode()])).hashes(), np.uint64(len(x))))) for x in held.dictionary.to_pylist()]
    return held.dictionary, np.array(hashes, np.uint64), held.indices.to_numpy(zero_copy_only=False)


def filter_of(frequent: DataFrame, size: int) -> np.ndarray:
    """Bits of the phrases of ``size`` words in (lang, phrase): FILTER_BITS of them, whatever the table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                _, known, lang = _langs(rows["lang"])
                h = Words(_feed(rows["phrase"].cast(pa.binary()).to_pylist())).hashes().reshape(-1, size)
                key = _key(known[lang], *h.T)
                masks = np.left_shift(np.uint64(1), key & np.uint64(63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(6)).astype(np.int64)), pa.array(masks)], ["slot", "mask"])

    slots = frequent.select("lang", "phrase").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[slots["slot"].to_numpy()] = slots["mask"].to_numpy().view(np.uint64)
    return bits


def grams(chunks: DataFrame, size: int, known: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, n: the phrases of ``size`` words in the texts that the chunks were parsed from.

    ``known`` marks phrases one word shorter: only phrases whose both such parts are marked are counted.
    """
    sent = chunks.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, "chunk"):
            found = _counted(rows, size, sent.value)
            if found.num_rows:
                yield found

    return chunks.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _counted(rows: pa.RecordBatch, size: int, known: np.ndarray | None) -> pa.RecordBatch:
    """``grams`` of some chunks."""
    held = rows["chunk"].cast(pa.binary()).to_pylist()
    words = Words(_feed(held))
    chunk = np.searchsorted(np.cumsum([len(x) + 1 for x in held]), words.place, side="right")
    # Of a chunk that does not close its text, the last two words start nothing here.
    closing = np.array([x.endswith(b"\n") for x in held])[chunk]
    after = np.concatenate((chunk[2:], [-1, -1]))[: len(chunk)]
    starts = closing | (chunk == after)
    coded = words.strings().dictionary_encode()
    code, v = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    langs, lang_hash, lang_at = _langs(rows["lang"])
    lang, weight = lang_at[chunk].astype(np.int64), rows["n"].to_numpy()[chunk]
    h = Words(np.frombuffer(b"".join(coded.dictionary.to_pylist()), np.uint8)).hashes()[code]
    n = len(words) - size + 1
    at = np.arange(max(n, 0))
    live = starts[: len(at)].copy()
    for k in range(size - 1):
        live &= ~words.ends[k : k + len(at)]
    at = at[live]
    if known is not None and len(at):
        parts = lambda first: [h[at + k] for k in range(first, first + size - 1)]
        of = lang_hash[lang[at]]
        at = at[_marked(known, _key(of, *parts(0))) & _marked(known, _key(of, *parts(1)))]
    key = lang[at]
    for k in range(size):
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]  # so that keys never pass 64 bits
        key = key * v + code[at + k]
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    count = np.bincount(place, weights=weight[at], minlength=len(first)).astype(np.int64)  # exact below 2^53
    plain = pc.binary_slice(coded.dictionary.cast(pa.binary()), 0, -1).cast(pa.string())
    own = at[first]
    parts = [plain.take(pa.array(code[own + k])) for k in range(size)]
    phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang[own])), phrase, pa.array(count)], ["lang", "phrase", "n"])


def counted(docs: DataFrame, least: int = LEAST, trigger: int = TRIGGER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per language: (lang, n) of all words; (lang, phrase, n) of words, of pairs and triples together, that occur ``least`` times."""
    spark = docs.sparkSession
    chunks = dictionary(docs, trigger)
    released(spark)
    words = stored(grams(chunks, 1), "words")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = words.where(F.col("n") >= least)
    pairs = stored(grams(chunks, 2, filter_of(frequent, 1)).where(F.col("n") >= least), "pairs")
    released(spark)
    triples = stored(grams(chunks, 3, filter_of(pairs, 2)).where(F.col("n") >= least), "triples")
    return totals, frequent, pairs.unionByName(triples)


def scored(words: DataFrame, phrases: DataFrame, inside: int = INSIDE_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score of the pairs and triples in ``phrases`` that no longer one takes the place of.

    ``words`` and ``phrases`` are (lang, phrase, n) and hold every part of a phrase.
    """
    counts = words.unionByName(phrases)
    split = F.split("phrase", " ")
    size = F.size(split)
    part = lambda a, b: F.array_join(F.slice(split, a, b), " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_l"), part(F.col("k") + 1, size - F.col("k")).alias("_r"))
    side = lambda key, c: counts.select("lang", F.col("phrase").alias(key), F.col("n").alias(c))
    cuts = cuts.join(side("_l", "l"), ["lang", "_l"]).join(side("_r", "r"), ["lang", "_r"])
    score = F.expr("(CAST(1000000 AS DECIMAL(7)) * CAST(a AS DECIMAL(15)) * CAST(a AS DECIMAL(15))) div (CAST(l AS DECIMAL(15)) * CAST(r AS DECIMAL(15)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A pair is inside a longer candidate, a triple inside none.
    longer = phrases.where(F.size(F.split("phrase", " ")) == 3).select("lang", "n", F.explode(F.array(part(F.lit(1), F.lit(2)), part(F.lit(2), F.lit(2)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE_PERCENT, top: int = TOP, trigger: int = TRIGGER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    totals, words, phrases = counted(docs, least, trigger)
    rows = scored(words, phrases, inside).withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    first = ranked(ranked(rows, "lang", "_s").drop("rank", "_s"), "lang")
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS size))),
c AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY ALL),
f AS MATERIALIZED (SELECT lang, phrase, n AS a, size, string_split(phrase, ' ') AS w FROM c WHERE size > 1 AND n >= 10),
k AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM f)),
s AS (SELECT k.lang, k.phrase, a, k, x.n AS l, y.n AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM k JOIN c x ON x.lang = k.lang AND x.phrase = k.x JOIN c y ON y.lang = k.lang AND y.phrase = k.y),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(unnest([w[1:2], w[2:3]]), ' ') AS phrase FROM f WHERE size = 3) GROUP BY ALL),
ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM c WHERE size = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
