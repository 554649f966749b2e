"""Mixing sources to target weights by soft membership, in DataFrame functions (the driver only inverts a matrix of the domains).

1. A classifier is fitted on the labelled table (LABELLED_ROWS of its rows at most, whole texts): naive Bayes over the presence of
   features. A text's features are its distinct words, as blanks delimit them, in lower case, and bins of its
   shape (share of distinct words for its length, share of marks, mean length of a word). Of the features
   in LEAST_TEXTS or more labelled texts those that differ most between a domain and the rest (chi-square)
   make the model, FEATURES of them at most, which bounds what is broadcast.
2. It gives every document a posterior over the domains, so a document counts towards several, and its
   tokens times its posterior are its expected tokens by domain. Features of one text are not independent,
   so their evidence counts by the power SHARPNESS.
3. Nonnegative rates, one for each document, are fitted by accelerated projected gradient least squares: the
   expected tokens by domain, summed over documents at their rates, are to match the targets. A step
   is one distributed aggregation to one number for each domain; rates are a function of these
   numbers, so no rate is kept between steps. Steps are weighted by a document's size and preconditioned
   by the domains' Gram matrix (k x k, one more aggregation), so that only the bound at zero makes more than one
   needed. Steps go on until the targets are met
   to TOLERANCE, or until STEPS of them no longer bring them nearer, which is told as a warning.

``budget`` says what the targets are shares of: "same" keeps the number of tokens, "repeat" takes the
least number of tokens at which no domain has to shrink, so documents are repeated but none is lost. The
targets are an input; TARGETS are those of a corpus that is to be mostly clean, whatever it holds now.

Domains come from ``labels``: toxic (1 in toxic), else low (0 in quality), else clean.

Defined results: a null or blank text has no tokens and keeps rate 1; without labels every document is
clean; labels that repeat count once, by their largest toxic and least quality; a target domain that no
document can belong to stays short; rows without a doc_id are never labelled; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import documents, numbered, stored, words_of

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.04, "toxic": 0.06}
FEATURES, LEAST_TEXTS, SHARPNESS = 512, 5, 0.5
#: Labelled rows that the classifier is fitted on at most, those with the least hash of doc_id.
LABELLED_ROWS = 8000
STEPS, TOLERANCE = 200, 1e-4
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number), one row for each labelled doc_id."""
    each = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return each.where("toxic IS NOT NULL OR quality IS NOT NULL").select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain"))


def featured(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns, n_tokens, features: an array of distinct strings for each row of ``docs`` (with ``text``)."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(*kept, low.alias("_t"), words_of(low).alias("_w"))
    rows = rows.select(*kept, "_t", F.size("_w").alias("n_tokens"), F.array_distinct("_w").alias("_d"))
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    chars, marks = F.char_length("_t"), F.octet_length("_t") - F.octet_length(F.translate("_t", MARKS, ""))
    shape = lambda name, *parts: F.concat_ws(":", F.lit(f" {name}"), *[F.floor(x).cast("string") for x in parts])  # noqa: E731  no word has a blank
    bins = F.array(shape("distinct", F.log2(n), 8 * F.size("_d") / n), shape("marks", F.least(20 * marks / n, F.lit(40))), shape("length", F.least(chars / n, F.lit(30))))
    return rows.select(*kept, "n_tokens", F.concat("_d", bins).alias("features"))


def model(docs: DataFrame, gold: DataFrame, count: int = FEATURES, least: int = LEAST_TEXTS, rows: int = LABELLED_ROWS) -> tuple[list[float], DataFrame]:
    """(log prior of each domain without any feature, table feature, e0, e1, ..): what a feature adds to each domain's log odds."""
    spark, k = docs.sparkSession, len(DOMAINS)
    picked = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = stored(featured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "domain"), "labelled")
    sizes = {r["domain"]: r["n"] for r in held.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    n = [sizes.get(d, 0) for d in range(k)]
    prior = [math.log(x / total) if x else (0.0 if not total and d == 0 else -1e9) for d, x in enumerate(n)]
    if len(sizes) < 2:
        return prior, spark.createDataFrame([], f"feature string, {', '.join(f'e{d} double' for d in range(k))}")
    seen = held.select("domain", F.explode("features").alias("feature"))
    by = seen.groupBy("feature").agg(F.count("*").alias("all"), *[F.count_if(F.col("domain") == d).alias(f"n{d}") for d in range(k)]).where(F.col("all") >= least)

    def chi(d: int) -> Column:
        a, rest = F.col(f"n{d}"), F.col("all") - F.col(f"n{d}")
        off = a * (total - n[d]) - rest * n[d]
        return F.lit(float(total)) * off * off / (F.lit(float(max(1, n[d] * (total - n[d])))) * F.col("all") * F.greatest(total - F.col("all"), F.lit(1)))

    best = by.withColumn("chi", F.greatest(*[chi(d) for d in sizes])).orderBy(F.desc("chi"), "feature").limit(count)
    share = [(F.col(f"n{d}") + 0.5) / (n[d] + 1) for d in range(k)]
    log_yes, log_no = [F.log(x) for x in share], [F.log(1 - x) for x in share]
    made = stored(best.select("feature", *[(y - z).alias(f"e{d}") for d, (y, z) in enumerate(zip(log_yes, log_no, strict=True))], *[z.alias(f"z{d}") for d, z in enumerate(log_no)]), "model")
    none = made.agg(*[F.sum(f"z{d}").alias(f"z{d}") for d in range(k)]).first()
    return [p + SHARPNESS * (none[f"z{d}"] or 0.0) for d, p in enumerate(prior)], made.drop(*[f"z{d}" for d in range(k)])


def memberships(docs: DataFrame, prior: list[float], table: DataFrame) -> DataFrame:
    """tag, doc_id, n_tokens, p0..: the posterior of each domain, for each (tag, doc_id, text). The model, FEATURES rows at most, is part of the plan."""
    names = [f"s{d}" for d in range(len(prior))]
    rows = featured(docs, "tag", "doc_id")
    held = table.orderBy("feature").collect()
    if held:
        # A row finds its features among the model's by hash, and only for those few their places: no row is made of a feature.
        known = F.array(*[F.lit(r["feature"]) for r in held])
        adds = [F.array(*[F.lit(r[f"e{d}"]) for r in held]) for d in range(len(prior))]
        none = F.struct(*[F.lit(0.0).alias(s) for s in names])
        places = F.transform(F.array_intersect("features", known), lambda w: F.array_position(known, w).cast("int"))
        found = F.aggregate(places, none, lambda acc, i: F.struct(*[(acc[s] + F.element_at(e, i)).alias(s) for s, e in zip(names, adds, strict=True)]))
        # Written before anything refers to it twice: the plan would otherwise make it anew for each reference.
        sums = stored(rows.select("tag", "doc_id", "n_tokens", found.alias("_s")), "evidence").select("tag", "doc_id", "n_tokens", *[(p + SHARPNESS * F.col(f"_s.{s}")).alias(s) for p, s in zip(prior, names, strict=True)])
    else:
        sums = rows.select("tag", "doc_id", "n_tokens", *[F.lit(p).alias(s) for p, s in zip(prior, names, strict=True)])
    top = F.greatest(*names)
    logs = sums.select("tag", "doc_id", F.col("n_tokens").cast("double").alias("n_tokens"), *[F.exp(F.greatest(F.col(s) - top, F.lit(-700.0))).alias(s) for s in names])
    whole = sum((F.col(s) for s in names[1:]), F.col(names[0]))
    # Rounded, so that posteriors do not differ by the order in which their evidence was added up.
    return logs.select("tag", "doc_id", "n_tokens", *[F.round(F.col(s) / whole, 6).alias(f"p{d}") for d, s in enumerate(names)])


def rate(steps: list[list[float]], domains: int) -> Column:
    """(r, y) of a document after the given steps: its rate, and the point where the next gradient is taken.

    Each step is one number for each domain and a momentum: r' = max(0, y - sum p * g), y' = r' + m * (r' - r).
    """
    one = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return one
    table = F.array(*[F.array(*[F.lit(float(g)) for g in s]) for s in steps])

    def step(s: Column, g: Column) -> Column:
        move = sum((F.col(f"p{d}") * g[d] for d in range(1, domains)), F.col("p0") * g[0])
        after = lambda r: F.struct(r.alias("r"), (r + g[domains] * (r - s["r"])).alias("y"))
        return F.get(F.transform(F.array(F.greatest(F.lit(0.0), s["y"] - move)), after), F.lit(0))

    return F.aggregate(table, one, step)


def rated(rows: DataFrame, targets: dict[str, float] | None, budget: str, steps: int) -> DataFrame:
    """``rows`` (n_tokens, p0..) with ``rate``."""
    targets = targets or TARGETS
    if budget not in ("same", "repeat"):
        raise ValueError(f"unknown budget {budget!r}")
    weights, k = [targets.get(d, 0.0) / sum(targets.values()) for d in DOMAINS], len(DOMAINS)
    # Rates depend on the posterior alone, so documents of equal posterior are one row of the fit.
    alike = stored(rows.groupBy(*[f"p{d}" for d in range(k)]).agg(F.sum("n_tokens").alias("n_tokens")), "posteriors")

    def masses(r: Column) -> tuple[list[float], list[float]]:
        """Expected tokens by domain at the rates, and at the points where the next gradient is taken."""
        sums = [F.sum(F.col("n_tokens") * F.col(f"p{d}") * F.col("_r")[at]).alias(f"{at}{d}") for at in "ry" for d in range(k)]
        got = alike.withColumn("_r", r).agg(*sums).first()
        return tuple([float(got[f"{at}{d}"] or 0.0) for d in range(k)] for at in "ry")

    pairs = [(a, b) for a in range(k) for b in range(k)]
    gram = alike.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{a}") * F.col(f"p{b}")).alias(f"g{a}{b}") for a, b in pairs]).first()
    inverse = np.linalg.pinv(np.array([[float(gram[f"g{a}{b}"] or 0.0) for b in range(k)] for a in range(k)]), rcond=1e-9)
    start, _ = masses(rate([], k))
    total = sum(start)
    if budget == "repeat":
        total = max((m / w for m, w in zip(start, weights, strict=True) if w > 0), default=total)
    aims, done, here, ahead, best, since = [w * total for w in weights], [], start, start, float("inf"), 0
    while total:
        worst = max(abs(n - a) for n, a in zip(here, aims, strict=True)) / total
        best, since = (worst, 0) if worst < 0.999 * best else (best, since + 1)
        if worst <= TOLERANCE:
            break
        if len(done) >= steps or since >= 20:
            warnings.warn(f"targets are missed by {worst:.4f} of all tokens after {len(done)} steps", stacklevel=3)
            break
        t = len(done)
        done.append([*(inverse @ (np.array(ahead) - np.array(aims))).tolist(), t / (t + 3)])
        here, ahead = masses(rate(done, k))
    return rows.withColumn("rate", F.when(F.col("n_tokens") > 0, rate(done, k)["r"]).otherwise(1.0))


def _rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, budget: str, steps: int) -> DataFrame:
    """tag, doc_id, n_tokens, p0.., rate: one row for each (tag, doc_id, text)."""
    rows = memberships(docs, *model(docs, domain_of(labels)))
    return rated(rows, targets, budget, steps)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: str = "same", steps: int = STEPS) -> DataFrame:
    """doc_id, n_tokens, p_clean, p_low, p_toxic, rate: one row for each row of ``docs``."""
    rows = _rates(docs.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "text"), labels, targets, budget, steps)
    return rows.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *[F.col(f"p{d}").alias(f"p_{name}") for d, name in enumerate(DOMAINS)], "rate")


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: str = "repeat", steps: int = STEPS) -> DataFrame:
    """``docs`` with each row written as often as its own rate asks: the whole part, and once more with the
    probability of the rest (by a hash of doc_id and text). Under "repeat" every row is written at least once."""
    rows = numbered(docs)
    texts = rows.select("tag", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    rates = _rates(texts, labels, targets, budget, steps).select("tag", F.col("rate").alias("_rate")).hint("merge")
    joined = rows.join(rates, "tag")
    chance = F.pmod(F.xxhash64("_row.doc_id", "_row.text", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(F.col("_rate") + chance).cast("int")
    times = F.greatest(times, F.lit(1)) if budget == "repeat" else times
    return joined.select("_row", times.alias("_times")).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def op1_mixing(spark, sf_dir):
    return mixed(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
