"""Search by blocks against all pairs, with ties, vectors without direction and blocks of any size."""

import numpy as np
import pytest

from castline.operators import retrieval


@pytest.mark.parametrize(("documents", "queries"), [(4096, 512), (7, 3), (1, 1)])
def test_search_by_blocks_equals_all_pairs(spark, monkeypatch, documents, queries):
    monkeypatch.setattr(retrieval, "DOCUMENT_BLOCK", documents)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", queries)
    rng = np.random.default_rng(1)
    vectors = [rng.integers(-2, 3, 4).astype(float).tolist() for _ in range(60)] + [[0.0] * 4, None, [1.0, 2.0]]
    docs = spark.createDataFrame([(str(i % 3), i, v) for i, v in enumerate(vectors)], "doc_type string, key long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, vectors[i]) for i in (0, 5, 9, 60, 61)], "query_id long, q array<double>")
    got = {}
    for r in retrieval.two_stage(asked, docs, {"first": (["0", "1"], 4), "last": (["2"], 2)}).collect():
        got.setdefault((r.query_id, r.stage), []).append((r["rank"], r.key, r.score))
    want = {}
    for q in (0, 5, 9):
        a = np.array(vectors[q])
        if not a.any():
            continue
        for stage, types, k in (("first", (0, 1), 4), ("last", (2,), 2)):
            scores = []
            for i, v in enumerate(vectors[:60]):
                b = np.array(v)
                if i != q and i % 3 in types and b.any():
                    scores.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9), str(i % 3), i))
            want[q, stage] = [(n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scores)[:k])]
    assert {k: [(r, i) for r, i, _ in sorted(v)] for k, v in got.items()} == {k: [(r, i) for r, i, _ in v] for k, v in want.items()}
    assert retrieval.search(asked.where("false"), docs, 3).count() == 0 == retrieval.search(asked, docs.where("false"), 3).count()
