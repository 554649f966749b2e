r"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Every word and the start of a text have a restaurant of the words that follow; all share one parent, the
restaurant of single words, over a uniform base of the V known words and one unknown. Tables are seated by the Chinese-restaurant process, dish by dish: a Gibbs sweep takes all
customers and tables of a dish out of a restaurant and seats them anew, given the other dishes' tables. Dishes
are swept side by side, each given the others as the sweep before left them. A text's score is the log of
the predictive probability, averaged over the kept sweeps.

Chance comes from a hash of (word, context, sweep, customer), so the scores follow from the rows alone,
however they are dealt out.

How it runs:

1. Tasks read texts in groups of about TOKENS tokens. A group becomes a stream (for each token, the
   place of its pair (previous word, word) in the group's list of distinct pairs) and that list with
   its training counts, cut into buckets by a hash of the word. So each pair crosses the network once
   a group instead of once a token.
2. A bucket has all pairs of its words, so parent and children of a word are seated in one task. What
   buckets share is one number of tables for each restaurant; these are summed after each sweep.
   Sweeps keep no state: a bucket replays earlier sweeps from the totals. Restaurants of words with
   ``share`` of the training tokens or more (at most 1/share of them) go by number, and their totals are
   broadcast. The others go by the hash of their word: a bucket sends its sums of these to owners, by
   ranges of the hash, and each owner sends it their totals back, so no task sees the totals of all. Where
   every customer sat at a table alone from the start, the first totals are the last. ``share`` only says
   which way totals go: scores are the same at any.
3. Buckets send each group the log probabilities of its pairs, in the order of its list, and the
   group's texts are summed up from its stream.

Counts cover all training texts, and the number of buckets and groups follows the input.

Defined results: a null or blank text has one token, its end; rows that repeat are scored alike (and
learned from as often as they stand there); a null doc_id is not held out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import documents, emptied, released, stored
from llm.shingles import mix

SHARE = 1e-6
TOKENS = 2_000_000
SWEEPS, BURN_IN = 3, 1
STRENGTH, ROOT_STRENGTH = 2.0, 10.0
ALONE = 128
END = 0x9D39247E33776D41  # hash of the end of a text, no word's own
NONE, START = 0, 1  # contexts: one that goes by its hash, the start of a text
FAR = 1 << 31  # from here on, a bucket's contexts that go by hash
CHUNK = 1 << 16  # broadcast totals that one task sums


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text leaves remainder 1 by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _pack(x: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones, which compress better so."""
    x = np.ascontiguousarray(x, dtype=kind).ravel()
    return zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return _numbers(zlib.decompress(raw), kind)


def contexts(docs: DataFrame, share: float = SHARE) -> np.ndarray:
    """Hashes of the words that are ``share`` of the training tokens or more, sorted; at most 1/share. Only their totals are broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()

        def counted() -> pd.DataFrame:
            return pd.DataFrame({"h": np.fromiter(map(_hash, n), np.uint64, len(n)).view(np.int64), "n": np.fromiter(n.values(), np.int64, len(n))})

        for b in batches:
            for text in b["text"]:
                n.update(words(text))
            if len(n) > 500_000:  # handed on in parts, so a task's memory is bounded
                yield counted()
                n.clear()
        yield counted()

    rows = docs.where(~held_out(F.col("doc_id"))).select("text").mapInPandas(run, "h long, n long")
    sums = stored(rows.groupBy("h").agg(F.sum("n").alias("n")), "words")
    total = sums.agg(F.sum("n")).first()[0]
    if not total:
        return np.empty(0, np.uint64)
    found = sums.where(F.col("n") >= max(1.0, share * total)).select("h").toPandas()["h"].to_numpy(np.int64)
    emptied(sums)
    return np.sort(found.view(np.uint64))


class Group:
    """Texts whose tokens share one list of distinct pairs."""

    def __init__(self, frequent: np.ndarray, buckets: int):
        self.frequent, self.buckets = frequent, buckets
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.tokens: list[list[int]] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id, text: str | None, held: bool) -> None:
        ids = self.ids
        row = [ids.setdefault(w, len(ids)) for w in words(text)]
        self.tokens.append(row)
        self.docs.append((doc_id, held))
        self.size += len(row) + 1

    def rows(self, g: int) -> Iterator[tuple]:
        """The stream, then the lists by bucket."""
        n_words = len(self.ids)
        hashes = np.fromiter(map(_hash, self.ids), np.uint64, n_words)
        at = np.searchsorted(self.frequent, hashes)
        known = at < len(self.frequent)
        known[known] = self.frequent[at[known]] == hashes[known]
        width = len(self.frequent) + 2
        by_hash = np.argsort(hashes)  # the other contexts by their place in this order
        place_of = np.empty(n_words, np.int64)
        place_of[by_hash] = np.arange(n_words)
        names = hashes[by_hash]
        context_of = np.where(known, at + 2, width + place_of).astype(np.int64)
        hashes = np.append(hashes, np.uint64(END))  # the end is word n_words
        lens = np.fromiter((len(t) + 1 for t in self.tokens), np.int64, len(self.tokens))
        word = np.concatenate([np.append(np.asarray(t, np.int64), n_words) for t in self.tokens])
        before = np.full(len(word), START, np.int64)
        before[1:] = np.append(context_of, NONE)[word[:-1]]
        before[np.cumsum(lens)[:-1]] = START
        train = np.repeat(np.array([not h for _, h in self.docs]), lens)
        order = np.lexsort((hashes, hashes % np.uint64(self.buckets)))  # by bucket, then hash
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        span = width + n_words
        pairs, place = np.unique(rank[word] * span + before, return_inverse=True)
        count = np.bincount(place, weights=train, minlength=len(pairs)).astype(np.int64)
        ids, held = [d for d, _ in self.docs], [bool(h) for _, h in self.docs]
        yield ("s", g, -1, _pack(place, "<i4"), None, None, ids, lens.tolist(), held)
        pair_hash, context = hashes[order][pairs // span], pairs % span
        far = context >= width
        upto = np.append(0, np.cumsum(far))
        named, context = names[context[far] - width], np.where(far, NONE, context)
        bucket = (pair_hash % np.uint64(self.buckets)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
            own, times = np.unique(pair_hash[a:b], return_counts=True)
            z = _pack(context[a:b], "<u4") + b"|" + _pack(count[a:b], "<u4") + b"|" + named[upto[a] : upto[b]].tobytes()
            yield ("l", g, int(bucket[a]), own.tobytes(), _pack(times, "<u4"), z, None, None, None)


_COLUMNS = ["kind", "g", "b", "x", "y", "z", "ids", "lens", "held"]


def grouped(docs: DataFrame, frequent: np.ndarray, buckets: int, tokens: int = TOKENS) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most 1/share hashes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, g = Group(sent.value, buckets), TaskContext.get().partitionId() << 32
        for b in batches:
            for row in zip(b["doc_id"], b["text"], b["held"], strict=True):
                group.add(*row)
                if group.size >= tokens:
                    yield pd.DataFrame(list(group.rows(g)), columns=_COLUMNS)
                    group.clear()
                    g += 1
        if group.size:
            yield pd.DataFrame(list(group.rows(g)), columns=_COLUMNS)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    schema = "kind string, g long, b int, x binary, y binary, z binary, ids array<string>, lens array<long>, held array<boolean>"
    return stored(rows.mapInPandas(run, schema), "groups", partition_by="kind")


def _list(x: bytes, y: bytes, z: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context, count) of each pair of a list, and the hashes of the contexts that are NONE."""
    opener, second = zlib.decompressobj(), zlib.decompressobj()
    context = _numbers(opener.decompress(z), "<u4")
    count = _numbers(second.decompress(opener.unused_data[1:]), "<u4")
    return np.repeat(np.frombuffer(x, np.uint64), _unpack(y, "<u4")), context, count, np.frombuffer(second.unused_data[1:], np.uint64)


def merged(lists: DataFrame) -> DataFrame:
    """A row for each bucket: its pairs by word, the hashes of contexts that go by them, and where the pairs of each group are among its pairs."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = [_list(*r) for r in zip(rows["x"], rows["y"], rows["z"], strict=True)]
        h, c, n, named = (np.concatenate([x[k] for x in got]) for k in range(4))
        ends = np.cumsum([len(x[1]) for x in got])
        del got
        own, word = np.unique(h, return_inverse=True)
        rare, at = np.unique(named, return_inverse=True)
        c = c.astype(np.int64)
        c[c == NONE] = FAR + at
        width = np.int64(1 << 32)
        pairs, place = np.unique(word.astype(np.int64) * width + c, return_inverse=True)
        count = np.bincount(place, weights=n, minlength=len(pairs)).astype(np.int64)
        each = [_pack(np.diff(p, prepend=0), "<u4") for p in np.split(place, ends[:-1])]
        return pd.DataFrame([(key[0], len(own), own.tobytes(), _pack(pairs // width, "<u4"), _pack(pairs % width, "<u4"), _pack(count, "<i8"), rare.tobytes(), rows["g"].tolist(), each)],
                            columns=["b", "n_words", "own", "word", "context", "count", "rare", "gs", "places"])

    schema = "b int, n_words int, own binary, word binary, context binary, count binary, rare binary, gs array<long>, places array<binary>"
    return stored(lists.groupBy("b").applyInPandas(run, schema), "buckets")


def uniform(key: np.ndarray, i: int) -> np.ndarray:
    """A number in [0, 1) for each key and customer i."""
    return (mix(key + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seated(count: np.ndarray, strength: np.ndarray, parent: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``count`` customers, seated one after another.

    The customer after i others at t tables opens a table with odds (strength + discount * t) * parent to
    i - discount * t; ``strength`` holds the restaurant's own strength and discount times its other tables. From
    ALONE customers on, the i-th and the next i/16 are seated at once, by the normal form of the binomial.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    open_ = np.flatnonzero(count > 1)
    i = 1
    while len(open_):
        step = 1 if i < ALONE else i // 16
        many = np.minimum(step, count[open_] - i)
        t, u = tables[open_], uniform(key[open_], i)
        new = (strength[open_] + discount * t) * parent[open_]
        p = new / (np.maximum(i - discount * t, 1e-9) + new)
        if step == 1:
            opened = u < p
        else:
            z = np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * uniform(key[open_], -i))
            opened = np.clip(np.rint(many * p + np.sqrt(many * p * (1 - p)) * z), 0, many).astype(np.int64)
        tables[open_] = t + opened
        i += step
        open_ = open_[count[open_] > i]
    return np.minimum(tables, count)


class Bucket:
    """Pairs of some words; replays sweeps from the totals that all buckets share.

    Contexts are numbered: below ``width`` as everywhere, from there on by the place of their hash in ``rare``.
    """

    def __init__(self, own: bytes, word: bytes, context: bytes, count: bytes, rare: bytes = b"", width: int = 0):
        self.hash = np.frombuffer(own, np.uint64)
        self.n_words = len(self.hash)
        self.word, self.context, self.count = _unpack(word, "<u4"), _unpack(context, "<u4").astype(np.int64), _unpack(count, "<i8")
        self.context[self.context >= FAR] += width - FAR
        self.rare, self.width = np.frombuffer(rare, np.uint64), width
        self.words = np.bincount(self.word, weights=self.count, minlength=self.n_words).astype(np.int64)

    def summed(self, weights: np.ndarray) -> np.ndarray:
        """Sums by context."""
        return np.bincount(self.context, weights=weights, minlength=self.width + len(self.rare)).astype(np.int64)

    def keyed(self, shape: dict) -> None:
        name = np.append(shape["names"], self.rare)[self.context] if shape.get("names") is not None else self.context.astype(np.uint64)
        self.pair = mix(self.hash[self.word] + mix(name))

    def told(self, answers: pd.DataFrame, history: list[dict], shape: dict) -> tuple[list[dict], dict]:
        """``history`` and ``shape`` with what the owners said of the contexts in ``rare``; sets which of these change from sweep to sweep."""
        answers = answers.sort_values(["k", "o"])
        said = [[_unpack(y, "<i8") for y in answers["y"][answers["k"] == k]] for k in range(len(history))]
        customers, tables = np.concatenate([y.reshape(2, -1) for y in said[0]], axis=1) if said[0] else np.zeros((2, 0), np.int64)
        self.open = customers != tables
        each = [tables]
        for y in said[1:]:
            tables = tables.copy()
            tables[self.open] = np.concatenate(y) if y else 0
            each.append(tables)
        full = [h | {"tables": np.append(h["tables"], t)} for h, t in zip(history, each, strict=True)]
        return full, shape | {"customers": np.append(shape["customers"], customers)}

    def sweep(self, k: int, parent: np.ndarray, tables: np.ndarray, root: np.ndarray, totals: dict, shape: dict):
        """(tables of each pair, customers and tables of each word in the parent), given those of the sweep before."""
        d, d0, seed = shape["discount"], shape["root_discount"], np.array([shape["seed"] + k], np.uint64)
        others = np.maximum(totals["tables"][self.context] - tables, 0)
        tables = seated(self.count, STRENGTH + d * others, parent[self.word], d, mix(self.pair ^ mix(seed)))
        customers = np.bincount(self.word, weights=tables, minlength=self.n_words).astype(np.int64)
        base, rest = np.full(self.n_words, 1 / (shape["types"] + 1)), np.maximum(totals["root_tables"] - root, 0)
        return tables, customers, seated(customers, ROOT_STRENGTH + d0 * rest, base, d0, mix(self.hash ^ mix(seed)))

    def parent(self, customers: np.ndarray, tables: np.ndarray, totals: dict, shape: dict) -> np.ndarray:
        d0 = shape["root_discount"]
        base = (ROOT_STRENGTH + d0 * totals["root_tables"]) / (shape["types"] + 1)
        return (np.maximum(customers - d0 * tables, 0) + base) / (ROOT_STRENGTH + totals["root_customers"])

    def replay(self, history: list[dict], shape: dict):
        """Yields (tables, parent's customers, parent's tables) of each sweep that ``history`` has the start of."""
        parent = (self.words + 0.5) / (shape["tokens"] + 0.5 * (shape["types"] + 1))
        tables, root = np.minimum(self.count, 1), np.minimum(self.words, 1)  # the start: a table for each dish
        self.keyed(shape)
        for k, totals in enumerate(history):
            tables, customers, root = self.sweep(k, parent, tables, root, totals, shape)
            yield tables, customers, root
            if k + 1 < len(history):
                parent = self.parent(customers, root, history[k + 1], shape)


#: Figures that are not a restaurant's.
TOKENS_, TYPES_, ONES_, TWOS_, ROOT_CUSTOMERS_, ROOT_TABLES_, ROOT_ONES_, ROOT_TWOS_ = range(-8, 0)
_SUMS = "b int, o int, x binary, y binary"


def _sums(b: int, k: Bucket, by: list[np.ndarray], extra: dict[int, int], owners: int, open_: np.ndarray) -> pd.DataFrame:
    """What bucket ``b`` has to say: sums by context, to the driver's restaurants (o < -1) and to owners (those in ``open_``), and other figures (o = -1)."""
    figures = np.zeros(8, np.int64)
    figures[list(extra)] = list(extra.values())
    out = [(b, -1, None, _pack(figures, "<i8"))]
    for n, at in enumerate(range(0, k.width, CHUNK)):
        out.append((b, -2 - n, None, _pack(np.concatenate([x[at : min(at + CHUNK, k.width)] for x in by]), "<i8")))
    names, mine = k.rare[open_], np.stack([x[k.width :][open_] for x in by])
    owner = ((names >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)  # ranges of the hash
    cut = np.searchsorted(owner, np.arange(owners + 1))
    for o in np.unique(owner).tolist():
        part = slice(cut[o], cut[o + 1])
        out.append((b, o, names[part].tobytes(), _pack(mine[:, part], "<i8")))
    return pd.DataFrame(out, columns=["b", "o", "x", "y"])


def _answers(sums: DataFrame, sweep: int) -> DataFrame:
    """(k, b, o, y): the totals of what each bucket asked for, in its order; those for the driver have b = -1."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(y, "<i8") for y in rows["y"]]
        if key[0] < 0:
            return pd.DataFrame([(sweep, -1, key[0], _pack(np.sum(got, axis=0), "<i8"))], columns=["k", "b", "o", "y"])
        names = [np.frombuffer(x, np.uint64) for x in rows["x"]]
        sizes = [len(x) for x in names]
        found, place = np.unique(np.concatenate(names), return_inverse=True)
        each = np.concatenate([y.reshape(-1, n) for y, n in zip(got, sizes, strict=True)], axis=1)
        total = np.stack([np.bincount(place, weights=x, minlength=len(found)) for x in each]).astype(np.int64)
        parts = np.split(place, np.cumsum(sizes)[:-1])
        return pd.DataFrame([(sweep, b, key[0], _pack(total[:, p], "<i8")) for b, p in zip(rows["b"], parts, strict=True)], columns=["k", "b", "o", "y"])

    return stored(sums.groupBy("o").applyInPandas(run, "k int, b int, o int, y binary"), "totals")


def _driver(answers: DataFrame, width: int, figures: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the restaurants that are broadcast, at most 1/share of them, one row for each figure; and the other figures."""
    rows = sorted(answers.where("b = -1").select("o", "y").collect(), reverse=True)
    if not rows:
        return np.zeros((figures, width), np.int64), np.zeros(8, np.int64)
    extra, *chunks = [_unpack(r.y, "<i8") for r in rows]
    return np.concatenate([c.reshape(figures, -1) for c in chunks], axis=1), extra


def owners_of(buckets: int) -> int:
    return max(16, buckets // 8)


def swept(buckets: DataFrame, width: int, sweeps: int = SWEEPS, seed: int = 5, names: np.ndarray | None = None, owners: int = 16) -> tuple[list[dict], dict, DataFrame]:
    """(totals at the start of each sweep and after the last, shape of the model, answers of the owners to each bucket)."""
    spark = buckets.sparkSession
    small = buckets.select("b", "own", "word", "context", "count", "rare")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                k = Bucket(r.own, r.word, r.context, r.count, r.rare, width)
                extra = {TOKENS_: k.words.sum(), TYPES_: (k.words > 0).sum(), ONES_: (k.count == 1).sum(), TWOS_: (k.count == 2).sum(), ROOT_CUSTOMERS_: (k.count > 0).sum(),
                         ROOT_ONES_: (k.words == 1).sum(), ROOT_TWOS_: (k.words == 2).sum()}
                yield _sums(r.b, k, [k.summed(k.count), k.summed(k.count > 0)], extra, owners, np.ones(len(k.rare), bool))

    told = _answers(small.mapInPandas(first, _SUMS), 0)
    by, got = _driver(told, width, 2)
    ratio = lambda a, b: min(0.95, max(0.05, got[a] / max(1, got[a] + 2 * got[b])))
    shape = {"tokens": int(got[TOKENS_]), "types": int(got[TYPES_]), "discount": ratio(ONES_, TWOS_), "root_discount": ratio(ROOT_ONES_, ROOT_TWOS_), "seed": seed,
             "customers": by[0].astype(np.float64), "names": names}
    history = [{"tables": by[1].astype(np.float64), "root_tables": float(shape["types"]), "root_customers": float(got[ROOT_CUSTOMERS_])}]
    told = told.where("b >= 0")
    for n in range(sweeps):
        released(spark)
        sent = spark.sparkContext.broadcast((history, shape))

        def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            r = next(rows.itertuples(index=False))
            k = Bucket(r.own, r.word, r.context, r.count, r.rare, width)
            *_, (t, customers, root) = k.replay(*k.told(answers, *sent.value))
            return _sums(r.b, k, [k.summed(t)], {ROOT_CUSTOMERS_: customers.sum(), ROOT_TABLES_: root.sum()}, owners, k.open)

        sums = small.groupBy("b").cogroup(told.groupBy("b")).applyInPandas(run, _SUMS)
        answers = _answers(sums, n + 1)
        by, got = _driver(answers, width, 1)
        history.append({"tables": by[0].astype(np.float64), "root_tables": float(got[ROOT_TABLES_]), "root_customers": float(got[ROOT_CUSTOMERS_])})
        told = told.unionByName(answers.where("b >= 0"))
    return history, shape, told


def fitted(buckets: DataFrame, width: int, sweeps: int = SWEEPS, seed: int = 5) -> tuple[list[dict], dict]:
    """``swept`` without the owners' answers, for a model whose contexts are all below ``width``."""
    return swept(buckets, width, sweeps, seed)[:2]


def looked_up(buckets: DataFrame, history: list[dict], shape: dict, told: DataFrame, burn_in: int = BURN_IN) -> DataFrame:
    """(g, b, logs, counts): log10 probability and the word's training count for each pair of a group's list."""
    sent = buckets.sparkSession.sparkContext.broadcast((history, shape))

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r = next(rows.itertuples(index=False))
        k = Bucket(r.own, r.word, r.context, r.count, r.rare, len(sent.value[1]["customers"]))
        past, model = k.told(answers, *sent.value)
        d = model["discount"]
        mean, kept = np.zeros(len(k.count)), 0
        for n, (tables, customers, root) in enumerate(k.replay(past[:-1], model)):
            if n < burn_in:
                continue
            after = past[n + 1]
            parent = k.parent(customers, root, after, model)[k.word]
            own = np.maximum(k.count - d * tables, 0) + (STRENGTH + d * after["tables"][k.context]) * parent
            mean += own / (STRENGTH + model["customers"][k.context])
            kept += 1
        logs, seen = np.log10(mean / kept), k.words[k.word]
        out = []
        for g, place in zip(r.gs, r.places, strict=True):
            at = np.cumsum(_unpack(place, "<u4"), dtype=np.int64)
            out.append((g, r.b, _pack(logs[at], "<f4"), _pack(seen[at], "<i8")))
        return pd.DataFrame(out, columns=["g", "b", "logs", "counts"])

    rows = buckets.select("b", "own", "word", "context", "count", "rare", "gs", "places")
    return rows.groupBy("b").cogroup(told.groupBy("b")).applyInPandas(run, "g long, b int, logs binary, counts binary")


def scored(docs: DataFrame, share: float = SHARE, sweeps: int = SWEEPS, burn_in: int = BURN_IN, tokens: int = TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    frequent = contexts(docs, share)
    n_buckets = max(16, min(1 << 16, 2 * docs.rdd.getNumPartitions()))
    rows = grouped(docs, frequent, n_buckets, tokens)
    released(docs.sparkSession)
    buckets = merged(rows.where("kind = 'l'").select("g", "b", "x", "y", "z"))
    lists = [f for f in rows.inputFiles() if "/kind=l/" in f]
    if lists:  # nothing reads the lists any more
        emptied(docs.sparkSession.read.parquet(lists[0].rsplit("/", 1)[0]))
    names = np.append(np.array([NONE, START], np.uint64), frequent)
    history, shape, told = swept(buckets, len(frequent) + 2, sweeps, names=names, owners=owners_of(n_buckets))
    released(docs.sparkSession)
    n, v = shape["tokens"], shape["types"]

    def run(key: tuple, streams: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        back = back.sort_values("b")
        logs = np.concatenate([_unpack(x, "<f4") for x in back["logs"]]).astype(np.float64)
        seen = np.concatenate([_unpack(x, "<i8") for x in back["counts"]])
        base = np.log10((seen + 0.5) / (n + 0.5 * (v + 1)))
        out = []
        for s in streams.itertuples(index=False):
            place, lens = _unpack(s.x, "<i4"), np.asarray(s.lens, np.int64)
            at = np.cumsum(lens) - lens
            out.append(pd.DataFrame({
                "doc_id": list(s.ids), "held_out": list(s.held), "n_tokens": lens, "n_known": np.add.reduceat((seen > 0).astype(np.int64)[place], at),
                "train_tokens": np.int64(n), "base_score": np.add.reduceat(base[place], at), "score": np.add.reduceat(logs[place], at),
            }))
        return pd.concat(out)

    found = stored(looked_up(buckets, history, shape, told, burn_in), "looked_up")
    emptied(buckets)
    released(docs.sparkSession)
    streams = rows.where("kind = 's'").select("g", "x", "ids", "lens", "held")
    result = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = streams.groupBy("g").cogroup(found.groupBy("g")).applyInPandas(run, result)
    return scores.withColumn("doc_id", F.col("doc_id").cast(kind))


def op6_lm_score(spark, sf_dir):
    return scored(documents(spark, sf_dir))
