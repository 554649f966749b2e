"""Collocations, spelling variants and licenses against brute-force versions, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from llm import collocations, licenses, spelling

SCHEMA = "doc_id long, text string, lang string, n long, key string, phrase string, word string, places string, _w string, _d string, chunk string"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, g, 1, "k", "p", "w", "x", "_", "_", "c") for d, t, g in rows], SCHEMA)


# Collocations ------------------------------------------------------------------------------------


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _counts(rows):
    count = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", _lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for size in (1, 2, 3):
                count["und" if lang is None else lang].update(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
    return count


def _collocations(rows, least, top):
    found = []
    for lang, c in _counts(rows).items():
        held = {p: a for p, a in c.items() if " " in p and a >= least}
        out = []
        for p, a in held.items():
            w = p.split(" ")
            cuts = [(10**6 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= 50 * a for q, b in held.items()):
                out.append((-score, -a, p.encode(), p, c[" ".join(w[:k])], c[" ".join(w[k:])]))
        n = sum(v for x, v in c.items() if " " not in x)
        found += [(lang, i + 1, x[3], -x[1], x[4], x[5], n, -x[0]) for i, x in enumerate(sorted(out)[:top])]
    return sorted(found)


def _random_texts(seed, rows=150):
    rng = random.Random(seed)
    words = [*"abcdefgh", "É", "İ", "x\x1cy", " ", "of", "the", "THE"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    text = lambda: "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", ". ", ",", "\n", " ;; ", "  "]) for _ in range(rng.randint(0, 80)))
    made = [(i, text() + (passage if rng.random() < 0.3 else ""), rng.choice(["en", "de", None, ""])) for i in range(rows)]
    return made + made[:20] + [(1, None, "en"), (2, "", None), (3, " \t\n ", "en"), (None, "a b c", "en"), (4, "a", "fr"), (5, ".a b.", "fr")]


@pytest.mark.parametrize("trigger", [1, 3, 16, 10**6])
def test_collocations_by_brute_force(spark, trigger):
    rows = _random_texts(trigger)
    got = collocations.collocations(_docs(spark, rows), least=4, top=40, trigger=trigger).collect()
    assert sorted(tuple(r) for r in got) == _collocations(rows, 4, 40)


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    monkeypatch.setattr(collocations, "BLOCK", 500)
    monkeypatch.setattr(collocations, "STRETCH", 40)
    rows = _random_texts(5)
    got = collocations.collocations(_docs(spark, rows), least=3, top=25).collect()
    assert sorted(tuple(r) for r in got) == _collocations(rows, 3, 25)


def test_chunks_are_reused_and_overlap(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randint(0, 999)}" for _ in range(400))
    rows = [(i, f"{' '.join(f'u{rng.randint(0, 10**6)}' for _ in range(30))} {passage}", "en") for i in range(20)]
    held = collocations.dictionary(_docs(spark, rows), trigger=8).collect()
    assert sum(r.n for r in held if r.n >= 20) > 0.6 * sum(r.n for r in held)
    texts = defaultdict(list)
    for r in held:
        texts[r.chunk.split(" ")[0]].append(r.chunk)
    assert all(len(r.chunk.split()) >= 3 or r.chunk.endswith("\n") for r in held)


def test_scores_beyond_64_bits(spark):
    n = 4_000_000_000_000
    words = spark.createDataFrame([("en", "a", n + 3), ("en", "b", n + 1)], "lang string, phrase string, n long")
    phrases = spark.createDataFrame([("en", "a b", n)], "lang string, phrase string, n long")
    (r,) = collocations.scored(words, phrases).collect()
    assert r.score == 10**6 * n * n // ((n + 3) * (n + 1)) == 999_999


def test_collocations_on_edges(spark):
    assert collocations.collocations(_docs(spark, [])).count() == 0
    long = _docs(spark, [(1, "word " * 300_000, None), (2, "x" * 200_000, "en")])
    (r,) = collocations.collocations(long).collect()
    assert (r.lang, r.phrase, r.a, r.l, r.r, r.n) == ("und", "word word word", 299_998, 300_000, 299_999, 300_000)


# Spelling variants ---------------------------------------------------------------------------------


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(words):
    form, out = {}, {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and _one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(near)
    found = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return sorted(found, key=lambda r: r[0])


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_neighbours_by_brute_force(spark, ranges):
    rng = random.Random(ranges)
    words = {"".join(rng.choice("aabé÷") for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 7, 30, 31, 160, 900, 5000]) for _ in range(500)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), ranges=ranges).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == _variants(words)


def test_chains_of_forms(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125, "zzzzzz": 5}
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaaa"] == ("aaaaab", "bbbbbb") and got["bbbbbb"] == (None, "bbbbbb") and got["zzzzzz"] == (None, "zzzzzz")


def test_vocabulary_by_brute_force(spark):
    rng = random.Random(1)
    runs = ["".join(rng.choice("abcÀÿé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    rows = [(rng.choice([*range(2000), None]), rng.choice(["", " ", "ß1"]).join([rng.choice([" ", "-", "Ā", "7"]) + rng.choice(runs).replace("a", rng.choice("aA")) for _ in range(40)]), None) for _ in range(400)] + [(1, None, None), (2, "", None)]
    count = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = _lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            count[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    got = {r.word: r.n for r in spelling.vocabulary(_docs(spark, rows)).collect()}
    assert got == {w: n for w, n in count.items() if len(w) >= 6 and n >= 5} and len(got) > 50


def test_spelling_on_edges(spark):
    run = lambda rows: sorted(tuple(r) for r in spelling.variants(spelling.vocabulary(_docs(spark, rows))).collect())
    assert run([]) == [] and run([(1, None, None), (2, "", None), (3, "short words", None)]) == []
    same = [(1, "letters", None)] * 6 + [(2, "y" * 3000, None)] * 5
    assert run(same) == [("letters", None, "letters", 6, 0, None), ("y" * 3000, None, "y" * 3000, 5, 0, None)]


# Licenses ------------------------------------------------------------------------------------------


def _places(text):
    w = [x for x in re.split(licenses.BREAKS, _lower(text)) if x]
    found = []
    for k, t in enumerate(licenses.TEMPLATES):
        for start in range(-len(t.words), len(w)):
            stand = [0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(t.words)]
            if all(s for s, m in zip(stand, t.must, strict=True) if m):
                found.append((k, start, stand))
    return w, found


def test_licenses_by_brute_force(spark):
    rng = random.Random(2)
    parts = [*(" ".join(t.words) for t in licenses.TEMPLATES), "MIT-License", "(Apache License)", "general, public\nlicense", "the", "license", "of mit", "é license", "cc by"]
    texts = []
    for _ in range(150):
        words = " / ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))).split()
        texts.append(rng.choice(["", "!", "a "]) + " ".join(w for w in words if rng.random() > 0.03) + rng.choice(["", "."]))
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(200, None, None), (201, "", None), (202, " \n", None), (None, "mit license", None), (None, "mit license", None)]
    n = len(rows)
    df = Counter(w for _, t, _ in rows for w in set(_places(t)[0]))
    weight = licenses.weights(_docs(spark, rows))
    assert {w for w in weight} == {w for t in licenses.TEMPLATES for w in t.words}
    assert sorted(weight, key=lambda w: (weight[w], w)) == sorted(weight, key=lambda w: (-df[w], w)) and n > 0
    got = Counter(tuple(r) for r in licenses.report(licenses.scan(_docs(spark, rows))).collect())
    want = Counter()
    for d, t, _ in rows:
        w, found = _places(t)
        base = [(licenses.TEMPLATES[k].label, s) for k, s, _ in found if licenses.TEMPLATES[k].named]
        starts = [s for _, s in base]
        share = [
            licenses.NAMED if (x := licenses.TEMPLATES[k]).named else sum(weight[w] for w, s in zip(x.words, stand, strict=True) if s) / sum(weight[w] for w in x.words)
            for k, _, stand in found
        ]
        joined = lambda labels: ",".join(sorted(set(labels)))
        want[(d, len(w), len(base), min(starts, default=None), max(starts, default=None), joined(x for x, _ in base), joined(licenses.TEMPLATES[k].label for k, _, _ in found), max(share, default=0.0))] += 1
    assert got == want and sum(1 for r in want if r[2]) > 20


def test_licenses_on_edges(spark):
    assert licenses.report(licenses.scan(_docs(spark, []))).count() == 0
    long = _docs(spark, [(1, "mit license " * 50_000, None), (2, "x" * 100_000 + " cc by nc 4.0", None)])
    got = {r.doc_id: r for r in licenses.report(licenses.scan(long)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (100_000, 50_000, 0, 99_998)
    assert got[2].labels == "cc-by-nc" and got[2].base_labels == "" and 0 < got[2].score < 1
