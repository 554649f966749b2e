r"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are the \n-split parts of a text, compared without the blanks around them; blank lines always
stay. Two lines are alike if single-character edits turn one into the other, at most ``edits`` of them
and at most one for each EVERY characters of the shorter line (so very short lines must be equal).
Alikeness is closed transitively, and of each class the first occurrence (by doc_id, then row, then
position) stays.

1. Distinct lines are found by their whole text and numbered, so no hash stands for a line.
2. A line of ``n`` characters is cut into edits + 1 even segments (as many edits as its length allows).
   Two lines within that many edits share a segment, at a place that the lengths bound: each line is
   indexed by (length, segment number, segment) and probes the indexes of its own and the next shorter
   lengths, only with the substrings that the multi-match-aware window allows.
3. Lines are dealt out by key once. Keys with several lines are found by aggregation (least and largest
   line, least indexed line), row by row, and joined back to the same shuffle, so no key's lines are
   gathered. A key's least indexed line is the star's centre.
4. Pairs whose letter counts allow it (an exact bound) are verified by banded bit-parallel edit
   distance, after what both begin and end with is cut off. Keys whose lines are not all connected
   after that are finished pair by pair across components.

Defined results: a null text stays null, an empty one empty; a text that loses every line becomes
empty; each row is a document, whether or not others share its doc_id, and takes its verdicts by a row
number; rows without a doc_id sort first; other columns are kept as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import BLANKS, documents, emptied, numbered, released, stored, texts_of
from llm.components import components

EDITS, EVERY = 2, 10
LETTERS = "etaonisrhldu cmg"


def _once(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits: banded bit-parallel distance.

    The band is 2 * edits + 2 rows around the diagonal, one bit each. A pair whose distance can no
    longer come down to ``edits`` is not computed on.
    """
    width = 2 * edits + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    lit = lambda v: F.lit(v).cast("long")
    inv = lambda x: F.bitwise_not(x).bitwiseAND(lit(full))

    def distance(p: Column, t: Column) -> Column:
        n, m = F.size(p), F.size(t)

        def step(s: Column, j: Column) -> Column:
            mask = lit(0)
            for k in range(width):
                at = j + (edits - (width - 1 - k))
                mask = mask + F.when((at >= 0) & (F.get(p, at) == F.get(t, j)), lit(1 << k)).otherwise(lit(0))
            diagonal = lambda x: x.bitwiseAND(s["vp"]) + s["vp"]
            d0 = lambda x: diagonal(x).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(lit(full))

            def after(d: Column) -> Column:
                hn = d.bitwiseAND(s["vp"])

                def ended(hp: Column) -> Column:
                    bit = F.call_function("shiftright", lit(top), F.greatest(j - (n - edits) + 1, F.lit(0)).cast("int"))
                    down = F.when(d.bitwiseAND(lit(top)) == 0, 1).otherwise(0)
                    along = F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
                    half = F.shiftright(d, 1)
                    return F.struct(
                        hn.bitwiseOR(inv(half.bitwiseOR(hp))).alias("vp"),
                        half.bitwiseAND(hp).alias("vn"),
                        (s["d"] + F.when(j < n - edits, down).otherwise(along)).alias("d"),
                    )

                return _once(s["vn"].bitwiseOR(inv(d.bitwiseOR(s["vp"]))), ended)

            live = s["d"] <= 2 * edits + m - n
            return F.when(live, _once(mask, lambda x: _once(d0(x), after))).otherwise(s)

        start = F.struct(lit((full << (width - edits - 1)) & full).alias("vp"), lit(0).alias("vn"), F.lit(edits).alias("d"))
        folded = F.aggregate(F.sequence(F.lit(0), m - 1), start, step, lambda s: s["d"])
        return F.when(n - m > edits, False).when((n <= edits) | (m == 0), True).otherwise(folded <= edits)

    def ordered(x: Column, y: Column) -> Column:
        return F.when(F.size(x) >= F.size(y), distance(x, y)).otherwise(distance(y, x))

    def same(x: Column, y: Column) -> Column:
        """How many characters both begin with."""
        n = F.least(F.size(x), F.size(y))
        differ = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p != q, F.lit(True))), F.lit(True)).cast("int")
        return F.when(differ == 0, n).otherwise(differ - 1)

    def trimmed(x: Column, y: Column) -> Column:
        return _once(same(x, y), lambda k: _once(F.reverse(F.slice(x, k + 1, F.size(x) - k)), lambda rx: _once(
            F.reverse(F.slice(y, k + 1, F.size(y) - k)),
            lambda ry: _once(same(rx, ry), lambda e: ordered(F.slice(rx, e + 1, F.size(rx) - e), F.slice(ry, e + 1, F.size(ry) - e))),
        )))

    chars = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > edits, False).otherwise(_once(chars(a), lambda x: _once(chars(b), lambda y: trimmed(x, y))))


def letter_counts(line: Column) -> list[Column]:
    """How often each of LETTERS occurs, as columns l0, l1, ...

    An edit changes these by two in all at most (a substitution takes one letter and adds another), so
    lines within ``edits`` edits differ by 2 * edits at most: a bound that never errs.
    """
    return [(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit("")))).alias(f"l{i}") for i, x in enumerate(LETTERS)]


def close(a: str, b: str, edits: int) -> Column:
    """Whether the letter counts in columns ``a``0.. and ``b``0.. allow ``edits`` edits."""
    apart = [F.abs(F.col(f"{a}{i}") - F.col(f"{b}{i}")) for i in range(len(LETTERS))]
    return sum(apart[1:], apart[0]) <= 2 * edits


def allowed(shorter: Column, edits: int) -> Column:
    """How many edits a pair may be apart whose shorter line has so many characters."""
    return F.least(F.lit(edits), F.floor(shorter / EVERY).cast("int"))


def windows(edits: int) -> list[tuple[int, int, int, int]]:
    """(edits, shorter by, segment number, offset) of every segment (0, 0) and probe, for 1 to ``edits`` edits."""
    return [
        (k, less, number, off)
        for k in range(1, edits + 1) for less in range(k + 1) for number in range(k + 1)
        for off in range(max(-number, less - (k - number)), min(number, less + (k - number)) + 1)
    ]


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """lid, key, indexed: the segments of each (lid, line, n), and the substrings with which it probes.

    A segment of an even cut into parts begins at base * number, and later by as many of the last
    segments, one character longer, as lie before it.
    """
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(w, ("k", "less", "number", "off"), strict=True)]) for w in windows(edits)])
    at = lines.where(F.col("n") >= EVERY).select("lid", "line", "n", F.explode(table).alias("w")).select("lid", "line", "n", "w.*")
    at = at.withColumn("m", F.col("n") - F.col("less")).where(F.col("k") == allowed(F.col("m"), edits))
    at = at.withColumn("base", F.expr("cast(m div (k + 1) AS int)")).withColumn("plain", F.expr("k + 1 - m % (k + 1)"))
    at = at.withColumn("size", F.col("base") + F.when(F.col("number") >= F.col("plain"), 1).otherwise(0))
    at = at.withColumn("at", F.col("base") * F.col("number") + F.greatest(F.lit(0), F.col("number") - F.col("plain")) + F.col("off"))
    at = at.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    key = F.xxhash64("m", "number", F.substring(F.col("line"), F.col("at") + 1, F.col("size")))
    return at.select("lid", key.alias("key"), ((F.col("less") == 0) & (F.col("off") == 0)).alias("indexed"))


def starred(keyed: DataFrame) -> DataFrame:
    """lid, key, indexed of ``keyed`` and the centre of each key with several lines, at least one of them indexed.

    Finding the stars and joining them back read one shuffle, so the keys are made once.
    """
    keyed = keyed.repartition("key")
    stars = keyed.groupBy("key").agg(
        F.min(F.when(F.col("indexed"), F.col("lid"))).alias("centre"), F.min("lid").alias("lo"), F.max("lid").alias("hi")
    )
    return keyed.join(stars.where("centre IS NOT NULL AND lo <> hi").select("key", "centre").hint("merge"), "key")


def occurrences(texts: DataFrame) -> DataFrame:
    """The other columns of ``texts``, pos, line: every line that is not blank, without the blanks around it."""
    rest = [c for c in texts.columns if c != "text"]
    split = texts.select(*rest, F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return split.select(*rest, "pos", F.btrim("raw", F.lit(BLANKS)).alias("line")).where("line <> ''")


def _digest(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def distinct_lines(texts: DataFrame) -> DataFrame:
    """lid, line, n, copies: each line once, with a number of its own."""
    lines = occurrences(texts.select("text")).groupBy("line").agg(F.count("*").alias("copies"))
    return stored(lines.select(F.monotonically_increasing_id().alias("lid"), "line", F.char_length("line").alias("n"), "copies"), "lines")


def alike(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(lid, component) of the distinct lines that are alike to another; other lines are left out."""
    # The small sides below grow with the corpus, so they are merged and not broadcast at any size.
    spark = lines.sparkSession
    members = stored(starred(segment_keys(lines, edits)), "members")
    released(spark)
    wanted = members.select("lid").distinct().hint("merge")
    texts = stored(lines.join(wanted, "lid", "left_semi").select("lid", "line", "n", *letter_counts(F.col("line"))), "texts")
    released(spark)

    counts = lambda k: [F.col(f"l{i}").alias(f"{k}{i}") for i in range(len(LETTERS))]

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs within the edits their length allows; letter counts are compared before the texts are fetched."""
        side = lambda k: texts.select(F.col("lid").alias(k), *counts(k))
        near = pairs.join(side("u"), "u").join(side("v"), "v").where(close("u", "v", edits)).select("u", "v")
        side = lambda k, c: texts.select(F.col("lid").alias(k), F.col("line").alias(c), F.col("n").alias(f"n{c}"))
        full = near.join(side("u", "a"), "u").join(side("v", "b"), "v").withColumn("k", allowed(F.least("na", "nb"), edits))
        ways = [(F.col("k") == k) & within(F.col("a"), F.col("b"), k) for k in range(1, edits + 1)]
        return full.where(functools.reduce(Column.__or__, ways, F.lit(False))).select("u", "v")

    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    once = lambda p: p.groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")
    links = stored(confirmed(once(members.where("lid <> centre").select(*pair("lid", "centre")))), "links")
    label = stored(components(links), "label")
    here = members.join(label.select(F.col("u").alias("lid"), "component"), "lid", "left").withColumn("component", F.coalesce("component", "lid"))
    mixed = here.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = here.join(mixed, "key").where("lid <> centre").select("key", "lid", "indexed", "component")
    rest = stored(open_.join(texts.drop("line", "n"), "lid"), "rest")
    x = rest.where("indexed").select("key", F.col("lid").alias("u"), F.col("component").alias("cu"), *counts("x"))
    y = rest.select("key", F.col("lid").alias("v"), F.col("component").alias("cv"), *counts("y"))
    more = stored(confirmed(once(x.join(y, ["key"]).where((F.col("cu") != F.col("cv")) & close("x", "y", edits)).select(*pair("u", "v")))), "links")
    if not more.isEmpty():
        label = stored(components(links.unionByName(more)), "label")
    for done in (members, texts, rest):
        emptied(done)
    return label.select(F.col("u").alias("lid"), "component")


def classes(texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """h1, h2, class: the lines (by a 128-bit hash) that occur more than once or are alike to another."""
    lines = distinct_lines(texts)
    released(texts.sparkSession)
    found = lines.join(alike(lines, edits).hint("merge"), "lid", "left").where("copies > 1 OR component IS NOT NULL")
    found = stored(found.select(*_digest("line"), F.coalesce("component", "lid").alias("class")), "classes")
    emptied(lines)
    released(texts.sparkSession)
    return found


def classed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """tag, doc_id, pos, class: the occurrences whose class has more than one."""
    at = occurrences(texts).select("tag", "doc_id", "pos", *_digest("line"))
    return stored(at.join(found.hint("merge"), ["h1", "h2"]).select("tag", "doc_id", "pos", "class"), "classed")


def firsts(rows: DataFrame) -> DataFrame:
    """class, group_size and the first occurrence's doc_id, tag and pos."""
    got = rows.groupBy("class").agg(F.min(F.struct("doc_id", "tag", "pos")).alias("_f"), F.count("*").alias("group_size"))
    return got.select("class", "group_size", "_f.*")


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """tag, doc_id, pos, group_size, kept: every line that is not blank."""
    texts = texts_of(numbered(docs))
    rows = classed(texts, classes(texts, edits))
    first = firsts(rows)
    sized = rows.join(first.select("class", "group_size"), "class").select("tag", "pos", "group_size")
    sized = sized.join(first.select("tag", "pos", F.lit(True).alias("_first")), ["tag", "pos"], "left")
    out = occurrences(texts).select("tag", "doc_id", "pos").join(sized, ["tag", "pos"], "left")
    return out.select("tag", "doc_id", "pos", F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.col("group_size").isNull() | F.col("_first").isNotNull()).alias("kept"))


def dedup_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with each text left with the lines that stay; all columns and rows are kept."""
    found = classes(docs.select("text"), edits)
    rows = numbered(docs)
    at = classed(texts_of(rows), found)
    # What is first in its class is taken out row by row, so no class is gathered in one task.
    marked = at.select("tag", "pos", F.lit(False).alias("first")).unionByName(firsts(at).select("tag", "pos", F.lit(True).alias("first")))
    gone = marked.groupBy("tag").agg(F.array_except(F.collect_set("pos"), F.collect_set(F.when(F.col("first"), F.col("pos")))).alias("_gone"))
    gone = stored(gone.where(F.size("_gone") > 0), "gone").hint("merge")
    released(docs.sparkSession)
    joined = rows.join(gone, "tag", "left")
    whole = F.col("_row.text")
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("_gone").isNull() | whole.isNull(), whole).otherwise(_once(F.split(whole, "\n"), lambda lines: F.array_join(left(lines), "\n")))
    return joined.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op7_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    whole = F.coalesce("text", F.lit(""))
    lines = lambda c: (F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return dedup_lines(docs).select(
        "doc_id", lines(whole).alias("n_lines"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


OP7_SQL = r"""
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
o AS MATERIALIZED (SELECT doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
d AS MATERIALIZED (SELECT line, row_number() OVER (ORDER BY line) AS k, length(line) AS n FROM (SELECT DISTINCT line FROM o WHERE line <> '')),
g AS MATERIALIZED (SELECT k, line, n, unnest([0, 1, 2]) AS s FROM d WHERE n >= 10),
x AS MATERIALIZED (SELECT k, n, s, substr(line, 1 + s * (n // 3), n // 3) AS piece, s * (n // 3) AS at FROM g),
y AS MATERIALIZED (SELECT k, line, n, unnest([0, 1, 2]) AS less FROM d WHERE n >= 10),
z AS MATERIALIZED (SELECT k, n - less AS m, s, substr(line, 1 + s * ((n - less) // 3) + off, (n - less) // 3) AS piece FROM y, (SELECT unnest([0, 1, 2]) AS s), (SELECT unnest([-2, -1, 0, 1, 2]) AS off) WHERE s * ((n - less) // 3) + off >= 0),
c AS MATERIALIZED (SELECT DISTINCT x.k AS a, z.k AS b FROM x JOIN z ON x.n = z.m AND x.s = z.s AND x.piece = z.piece AND x.k <> z.k),
e AS MATERIALIZED (SELECT a, b FROM c JOIN d p ON p.k = a JOIN d q ON q.k = b WHERE levenshtein(p.line, q.line) <= least(2, p.n // 10)),
w AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS k, a AS t FROM w UNION SELECT r.k, w.b FROM r JOIN w ON w.a = r.t),
q AS MATERIALIZED (SELECT k, min(t) AS c FROM r GROUP BY k),
v AS MATERIALIZED (SELECT o.doc_id, o.pos, o.raw, d.k IS NULL OR row_number() OVER (PARTITION BY coalesce(q.c, d.k) ORDER BY o.doc_id, o.pos) = 1 AS kept FROM o LEFT JOIN d ON d.line = o.line LEFT JOIN q ON q.k = d.k),
t AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS text FROM v WHERE kept GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(coalesce(t.text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents LEFT JOIN t USING (doc_id)
"""
