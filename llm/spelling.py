r"""Spelling variants: exact neighbours at one edit, by pairs of trie nodes.

Words come from maximal runs ``[A-Za-zÀ-ÿ]+`` with A-Z in lower case (``vocabulary``).

1. The words are sorted by ranges and each range is walked once: a word shares the nodes of its common
   prefix with the word before, and the rest of its path gets new numbers. The same over reversed words
   numbers the suffixes. The walk holds one path, whatever the range. Where ranges meet, the nodes of the prefix
   that both sides share have a number from each side; ``_aliases`` has one row for each of these, and the later number gives way.
2. A word without its i-th character is the pair (prefix node i, suffix node of what follows it); a word with
   a gap before its i-th character is (prefix node i, suffix node from i). Words that share a skipped pair
   differ by a replaced character; a word whose gap is another's skip is that word less one character.
   Nodes are numbers of strings and not hashes, so a shared pair is proof and nothing has to be compared after.
3. A pair has at most one word for each letter of the alphabet and one for its gap. So it is gathered whole; each word
   takes from it a count and its largest neighbour, no list of pairs. Of equal adjacent characters only the skip of
   the first counts against a gap, so no neighbour is counted twice.
4. ``form`` is the largest neighbour where it is RATIO times as frequent. Frequencies grow by RATIO with each form, so
   chains are short; ``root`` follows them by doubling.

Defined results: a null or empty text has no words; a null doc_id is written as nothing before the colon;
repeated rows count each time; an empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import documents, lower_ascii, stored

BREAKS = "[^A-Za-zÀ-ÿ]+"
#: One of DAMAGED runs loses a character.
DAMAGED, LEAST_CHARS, LEAST_COUNT, RATIO = 199, 6, 5, 5
GAP, AGAIN, SKIP = 0, 1, 2


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), BREAKS)).alias("_r"))
    low = runs.where(F.char_length("_r") >= least_chars).select("_d", lower_ascii(F.col("_r")).alias("_r"))
    hashed = low.select("_r", F.crc32(F.concat("_d", F.lit(":"), "_r")).alias("_h"))
    at = (F.col("_h") % F.char_length("_r")).cast("int")
    word = F.when(F.col("_h") % DAMAGED == 0, F.concat(F.substring("_r", F.lit(1), at), F.substring("_r", at + 2, F.char_length("_r")))).otherwise(F.col("_r"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def numbered_nodes(words: DataFrame, key: Column, ranges: int | None = None) -> DataFrame:
    """word, n, wid, nodes: the number of the trie node of each prefix of ``key``, the empty one first; wid rises with the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        before, path, free, wid = "", [base], base + 1, base
        for rows in batches:
            nodes, wids = [], []
            for k in rows["key"]:
                same, most = 0, min(len(before), len(k))
                while same < most and before[same] == k[same]:
                    same += 1
                new = len(k) - same
                path = path[: same + 1] + list(range(free, free + new))
                free += new
                before = k
                nodes.append(path)
                wids.append(wid)
                wid += 1
            yield pd.DataFrame({"word": rows["word"], "n": rows["n"], "key": rows["key"], "wid": wids, "nodes": nodes})

    keyed = words.select("word", "n", key.alias("key"))
    ranged = keyed.repartitionByRange(ranges, "key") if ranges else keyed.repartitionByRange("key")
    walked = ranged.sortWithinPartitions("key").mapInPandas(run, "word string, n long, key string, wid long, nodes array<long>")
    return stored(walked, "nodes")


def _aliases(nodes: DataFrame) -> DataFrame:
    """number, same_as: of the nodes that two ranges or more have in common, the later numbers and the first one.

    One row comes from each range (its first and last word), and as many go back as neighbouring ranges share characters.
    """
    ends = nodes.groupBy(F.shiftright("wid", 40).alias("part")).agg(
        F.min(F.struct("key", "nodes")).alias("low"), F.max(F.struct("key", "nodes")).alias("high")
    )
    same: dict[int, int] = {}
    last = None
    for row in ends.orderBy("part").collect():
        if last:
            for i in range(len(row["low"]["nodes"])):
                if i and (i > len(last["key"]) or last["key"][i - 1] != row["low"]["key"][i - 1]):
                    break
                same[row["low"]["nodes"][i]] = same.get(last["nodes"][i], last["nodes"][i])
        last = row["high"]
    return nodes.sparkSession.createDataFrame(list(same.items()), "number long, same_as long")


def _renumbered(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    near = F.broadcast(aliases.select(F.col("number").alias(column), "same_as"))
    return rows.join(near, column, "left").withColumn(column, F.coalesce("same_as", column)).drop("same_as")


def node_pairs(words: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(word, n, wid of every word; prefix, suffix, wid, n, kind of every skip and gap)."""
    forward, backward = numbered_nodes(words, F.col("word"), ranges), numbered_nodes(words, F.reverse("word"), ranges)
    both = forward.select("word", "n", "wid", F.col("nodes").alias("f")).join(backward.select("word", F.col("nodes").alias("b")), "word")
    both = both.withColumn("c", F.split("word", "")).withColumn("size", F.size("f") - 1)
    pair = lambda i, rest, kind: F.struct(F.get("f", i).alias("prefix"), F.get("b", rest).alias("suffix"), kind.alias("kind"))
    first = lambda i: F.when(F.get("c", i) == F.get("c", i - 1), AGAIN).otherwise(SKIP)
    skips = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: pair(i, F.col("size") - 1 - i, first(i)))
    gaps = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: pair(i, F.col("size") - i, F.lit(GAP)))
    pairs = both.select("wid", "n", F.explode(F.concat(skips, gaps)).alias("p")).select("wid", "n", "p.*")
    pairs = _renumbered(_renumbered(pairs, "prefix", _aliases(forward)), "suffix", _aliases(backward))
    return forward.select("word", "n", "wid"), pairs


def neighbours(pairs: DataFrame) -> DataFrame:
    """wid, n_near, best (n, and the word's number with its sign turned): of the words that have a neighbour."""
    held = pairs.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("n", (-F.col("wid")).alias("order"), "kind")).alias("m")).where(F.size("m") > 1)
    held = held.select(F.sort_array("m", asc=False).alias("m"))

    def near(x: Column, y: Column) -> Column:
        both = (x["kind"] != GAP) & (y["kind"] != GAP)
        return (x["order"] != y["order"]) & (both | (x["kind"] == SKIP) | (y["kind"] == SKIP))

    def seen(x: Column) -> Column:
        found = F.filter("m", lambda y: near(x, y))
        return F.get(F.transform(F.array(found), lambda f: F.struct((-x["order"]).alias("wid"), F.size(f).alias("n_near"), F.get(f, F.lit(0)).alias("best"))), F.lit(0))

    each = held.select(F.explode(F.transform("m", seen)).alias("x")).select("x.wid", "x.n_near", F.struct("x.best.n", "x.best.order").alias("best"))
    each = each.where("n_near > 0")
    return each.groupBy("wid").agg(F.sum("n_near").cast("long").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """wid, root: the end of the chain of (wid, form). Each round doubles the steps taken."""
    here = stored(forms.select("wid", F.col("form").alias("root")), "roots")
    while True:
        there = here.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        after = stored(here.join(there, "root", "left").select("wid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        here = after.drop("moved")
        if after.where("moved").isEmpty():
            return here


def variants(words: DataFrame, ratio: int = RATIO, ranges: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root for each (word, n); words are distinct."""
    named, pairs = node_pairs(stored(words, "words"), ranges)
    near = neighbours(pairs)
    rows = named.join(near, "wid", "left").withColumn("form", F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.order")))
    rows = stored(rows.select("word", "n", "wid", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form"), "near")
    forms = rows.where("form IS NOT NULL").select("wid", "form")
    ends = forms.join(roots(forms), "wid")
    names = lambda c, *more: named.select(F.col("wid").alias(c), *more)
    told = ends.join(names("form", F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form").join(names("root", F.col("word").alias("root_word")), "root")
    return rows.drop("form").join(told.select("wid", "form_word", "form_n", "root_word"), "wid", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling(spark, sf_dir):
    return variants(vocabulary(documents(spark, sf_dir)))


OP12_SQL = r"""
WITH RECURSIVE step AS (SELECT i AS b, i AS x, 0 AS k FROM range(256) r(i) UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY b) AS t FROM step WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
c AS MATERIALIZED (SELECT d, r, count(*) AS n, hex(encode(d || ':' || r)) AS x FROM runs WHERE length(r) >= 6 GROUP BY d, r),
h AS MATERIALIZED (SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS h FROM c, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS MATERIALIZED (SELECT word, n, i, left(word, i) || right(word, length(word) - i - 1) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
d AS MATERIALIZED (SELECT DISTINCT s.word AS long, s.n AS long_n, w.word AS short, w.n AS short_n FROM s JOIN w ON s.less = w.word),
e AS MATERIALIZED (SELECT a.word, a.n, b.word AS other, b.n AS m FROM s a JOIN s b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT long, long_n, short, short_n FROM d UNION ALL SELECT short, short_n, long, long_n FROM d),
f AS MATERIALIZED (SELECT word, n, count(*) AS n_near, arg_max(other, (m, -k)) AS best, max(m) AS best_n FROM (SELECT *, row_number() OVER (ORDER BY other) AS k FROM e) GROUP BY word, n),
g AS MATERIALIZED (SELECT word, best AS form, best_n AS form_n FROM f WHERE best_n >= 5 * n),
chain AS (SELECT word, form, 1 AS k FROM g UNION ALL SELECT chain.word, g.form, k + 1 FROM chain JOIN g ON g.word = chain.form),
roots AS (SELECT word, arg_max(form, k) AS root FROM chain GROUP BY word)
SELECT w.word, g.form, coalesce(roots.root, w.word) AS root, w.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, g.form_n
FROM w LEFT JOIN f USING (word) LEFT JOIN g USING (word) LEFT JOIN roots USING (word)
"""
