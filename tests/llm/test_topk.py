import math
import random

import numpy as np

from lodestar.llm.queries import QUERIES
from lodestar.llm.topk import quantised, search_block, top_k

SCHEMA = "vec_id long, embedding array<float>, v string, query_id int"


def brute(rows, k, is_query):
    fit = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v = [math.floor(256 * float(np.float32(x))) for x in e]
            fit[i] = min(fit.get(i, v), v)
    out = []
    for q, v in fit.items():
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fit.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5, **kw):
    vectors = quantised(spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA))
    return sorted(tuple(r) for r in top_k(vectors, vectors.where("vec_id % 5 = 0"), k, **kw).collect())


def test_against_brute_force_with_ties_and_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(40)]) for i in range(300)] + [(i, [0.5] * 40) for i in range(300, 360)]
    rows += [(400, None), (401, [None] * 40), (402, [float("nan")] * 40), (403, [float("inf")] * 40), (None, [1.0] * 40), (405, [1.0]), (406, [2.0]), (410, []), (0, [0.1] * 40), (5, rows[5][1])]
    assert run(spark, rows, row_block=64, query_block=16) == brute(rows, 5, lambda q: q % 5 == 0)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.25, 0.5])]
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 5 == 0) == [(0, 1, 1, -16384 - 0 + 256 * 64 - 256 * 128 + 16384)]
    assert run(spark, []) == []


def test_large_components_stay_exact():
    v = np.array([[2**30, 1], [2**30, 2], [3, -(2**30)]])
    assert [(i.tolist(), [int(x) for x in s]) for i, s in search_block(v, np.array([1, 2, 3]), v[:1], 3)] == [([2, 1, 3], [2**60 + 2, 2**60 + 1, 3 * 2**30 - 2**30])]


def test_registered_query_keeps_every_row(spark, tmp_path):
    r = random.Random(4)
    rows = [(i % 120, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(3, [9.0] * 8)] * 2 + [(0, [9.0] * 8), (50, None), (None, [1.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    fit = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None]
    want = []
    for r, (q, v) in enumerate(fit):
        if q % 50 == 0:  # every row is a query of its own, and only its own row is no candidate
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for c, (i, w) in enumerate(fit) if c != r)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    want.sort()
    assert sorted(tuple(x) for x in QUERIES["op6_exact_topk"](spark, str(tmp_path)).collect()) == want


def test_huge_components_against_whole_numbers(spark):
    """Scores beyond 2 ** 53 and beyond the range of a long; the latter count as its ends."""
    rng = np.random.default_rng(5)
    for top in (2**20, 2**31, 2**62):
        v = rng.integers(-top, top, (200, 40))
        v[50:60] = v[0]
        ids = np.arange(200)
        clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        for own, (best, scores) in enumerate(search_block(v, ids, v[:20], 5)):
            every = sorted((-clip(sum(int(a) * int(b) for a, b in zip(v[own], w, strict=True))), i) for i, w in enumerate(v))
            assert list(zip([-s for s in scores], best.tolist(), strict=True)) == every[:5]
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 1.0])]
    assert [x[2:] for x in run(spark, rows)] == [(1, 2**63 - 1), (2, -(2**63))]


def test_repeated_rows_and_other_vectors_of_one_id(spark):
    vectors = quantised(spark.createDataFrame([(0, [1.0, 0.0], "x", 1), (1, [0.5, 0.5], "x", 1), (1, [0.9, 0.1], "x", 1), (1, [0.9, 0.1], "x", 1)], SCHEMA), every_row=True)
    assert [x.score for x in top_k(vectors, vectors.where("vec_id = 0"), 5).orderBy("rank").collect()] == [58880, 58880, 32768]
    assert len(top_k(vectors, vectors.where("vec_id = 1"), 5).collect()) == 9  # three queries, three other rows each


def test_rows_that_share_an_id_find_each_other(spark):
    def found(rows, k=5):
        vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every_row=True)
        return sorted(tuple(r) for r in top_k(vectors, vectors.where("vec_id % 50 = 0"), k).collect())

    assert found([(0, [1.0, 0.0]), (0, [0.8, 0.2])]) == [(0, 1, 0, 256 * 204)] * 2
    same = [(0, [0.5, 0.5])] * 3  # equal in all: each has the two others
    assert found(same) == sorted([(0, 1, 0, 2 * 128 * 128), (0, 2, 0, 2 * 128 * 128)] * 3)
    assert found(same, k=1) == [(0, 1, 0, 2 * 128 * 128)] * 3
    assert found([(0, [0.1, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 0.0])], k=1) == sorted([(0, 1, 0, 25 * 256), (0, 1, 7, 256 * 256)])
