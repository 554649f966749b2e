"""Quality rules as a short-circuit cascade.

The order of the rules is planned from a sample. A rule's cost is the time to make its figure from the
texts and compare it: the sample is gone through REPEATS times in one job, and the time of the same job
without a rule is taken off. Its selectivity is what it rejects of the sample rows that no earlier rule
rejects. The rule with most rejections a second comes first, then the next of those left. A row stops
at the first rule that rejects it (CASE WHEN evaluates in order), so a costly figure is only made for what
the cheap rules let through. The order changes the time and ``rejected_by``, never ``kept``.

``keep`` makes figures behind the rules that come before. ``judge`` returns the figures of all rows, so it
makes all of them; only what no column shows (lines, shouts) is left to the cascade there.

Defined results: a null or blank text has no words and fails ``few_words``; repeated rows are judged
alike; an empty table gives an empty result and the declared order; columns of the input beside those
named are ignored, so names that clash with results do no harm.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import BLANKS, documents, packed, words_of

WINDOW = 8
SAMPLE_ROWS, REPEATS, RUNS = 1000, 8, 2


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition on the columns of ``measure``, or on a text ``_t`` and its words ``_w``."""

    name: str
    rejects: Column


def _count(text: Column, piece: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def symbols(text: Column) -> Column:
    r"""Characters of ``[#*$%&|<>]``."""
    return (F.octet_length(text) - F.octet_length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    r"""``\n``-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more, first included.

    Windows are compared by the 64-bit hash of their words' hashes. A text whose windows all differ
    (most) ends after the distinct count; only others are sorted to find the repeated positions.
    """
    spread = lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(WINDOW)]),
    )
    covered = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"].cast("long"),
    )
    placed = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    twice = lambda s: F.array_sort(F.filter(
        F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])),
        lambda p: p.isNotNull(),
    ))
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    hashes = once(F.transform(words, lambda x: F.xxhash64(x)), spread)
    found = once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(once(placed(h), lambda s: covered(twice(s)))))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(found)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    return (
        docs.select("doc_id", F.col("text").alias("_t"))
        .withColumn("_w", words_of(F.col("_t")))
        .select(
            "doc_id",
            F.col("_t").alias("text"),
            F.size("_w").cast("long").alias("n_words"),
            word_chars(text).alias("word_chars"),
            symbols(text).alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            repeated_words(F.col("_w")).alias("n_repeat_words"),
        )
    )


def word_chars(text: Column) -> Column:
    """Characters that are not blanks."""
    return F.char_length(F.translate(text, BLANKS, "")).cast("long")


def _rules(n: Column, repeat_words: Column, n_symbols: Column, chars: Column, dup_lines: Column, text: Column) -> list[Rule]:
    """The one list of rules, on figures or on the expressions that make them. Base: few_words and repeated_words."""
    return [
        Rule("few_words", n < 20),
        Rule("repeated_words", 100 * repeat_words > 30 * n),
        Rule("symbols", n_symbols > 0.1 * n),
        Rule("shouting", _count(text, "!!") > 0.1 * n),
        Rule("word_length", (chars > 15 * n) | (chars < 2 * n)),
        Rule("repeated_lines", dup_lines > 0.5 * F.size(F.split(text, "\n"))),
    ]


def text_rules() -> list[Rule]:
    """The rules on a text ``_t`` (never null) and its words ``_w``."""
    t, w = F.col("_t"), F.col("_w")
    return _rules(F.size(w), repeated_words(w), symbols(t), word_chars(t), duplicate_lines(t), t)


def figure_rules() -> list[Rule]:
    """The same rules on figures that ``measure`` has made."""
    figures = [F.col(c) for c in ("n_words", "n_repeat_words", "n_symbols", "word_chars", "n_dup_lines")]
    return _rules(*figures, F.coalesce(F.col("text"), F.lit("")))


def sampled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``sample_rows`` rows, drawn before any figure is made of them."""
    return docs.sample(fraction=min(1.0, sample_rows / max(1, docs.count())), seed=seed)


def opened(docs: DataFrame) -> DataFrame:
    """``_row``, text ``_t`` (never null), words ``_w``."""
    return packed(docs).select("_row", F.coalesce(F.col("_row.text"), F.lit("")).alias("_t")).withColumn("_w", words_of(F.col("_t")))


def planned(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> list[tuple[Rule, float, float]]:
    """(rule on ``_t`` and ``_w``, seconds, share of the sample that it rejects and no earlier one does), in the order to run.

    The sample is evaluated on the executors; counts by which rules reject, and times, come back.
    """
    rules = rules or text_rules()
    sample = opened(sampled(docs, sample_rows)).select("_t", "_w").persist()
    try:
        n = sample.count()
        together = sample.groupBy(*[r.rejects.alias(f"r{i}") for i, r in enumerate(rules)]).count().collect()
        again = sample.select("_t", "_w", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_k"))

        def seconds(condition: Column) -> float:
            found = []
            for _ in range(RUNS):
                began = time.perf_counter()
                again.agg(F.count_if(condition)).first()
                found.append(time.perf_counter() - began)
            return min(found)

        alone = seconds(F.col("_k") < 0)
        cost = [max(seconds(r.rejects) - alone, 1e-4) for r in rules]
    finally:
        sample.unpersist()
    order, left = [], list(range(len(rules)))
    while left:
        share = {i: sum(row["count"] for row in together if row[f"r{i}"]) / max(1, n) for i in left}
        best = max(left, key=lambda i: share[i] / cost[i])
        order.append((rules[best], cost[best], share[best]))
        left.remove(best)
        together = [row for row in together if not row[f"r{best}"]]
    return order


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, in the given order; null if none does."""
    chain = F.lit(None).cast("string")
    for r in reversed(rules):
        chain = F.when(r.rejects, F.lit(r.name)).otherwise(chain)
    return chain


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the figures, base_failed, kept, rejected_by."""
    by_name = {r.name: r for r in figure_rules()}
    order = [by_name[r.name] for r, _, _ in planned(docs, sample_rows=sample_rows)]
    return (
        measure(docs).withColumn("rejected_by", cascade(order))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
            F.col("rejected_by").isNull().alias("kept"),
            "rejected_by",
        )
    )


def keep(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects. No figure is made that no rule needs."""
    order = [r for r, _, _ in planned(docs, rules, sample_rows)]
    return opened(docs).where(cascade(order).isNull()).select("_row.*")


def op3_quality(spark, sf_dir):
    return judge(documents(spark, sf_dir)).drop("rejected_by")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT row_number() OVER () AS k, *, string_split(text, chr(10)) AS ls, len(w) AS n FROM t),
g AS (SELECT k, w[i:i+7] AS win, i FROM (SELECT k, w, unnest(range(1, greatest(n - 6, 1))) AS i FROM f)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM g) WHERE c > 1),
p AS (SELECT k, sum(least(8, coalesce(i - prev, 8))) AS n_repeat FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM r) GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT s) AS dup FROM (SELECT k, unnest(ls) AS s FROM f) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
  CAST(floor((length(text) - length(replace(text, '!!', ''))) / 2) AS BIGINT) AS shouts
  FROM f LEFT JOIN p USING (k) LEFT JOIN l USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > 0.1 * n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR n_dup_lines > 0.5 * n_lines OR shouts > 0.1 * n_words) AS kept
FROM m
"""
