"""Late interaction against brute force."""

import numpy as np

from lodestar.operators import late


def brute(docs, queries, k):
    out = []
    for q, qv in queries:
        scored = sorted((-round(sum(max(float(a @ b) for b in v) for a in qv), 9), d) for d, v in docs if d != q)
        out += [(q, i, d, -s) for i, (s, d) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_max_sim(spark):
    r = np.random.default_rng(3)
    rows = [(d, p, r.normal(0, 1, 12).tolist()) for d in range(150) for p in range(int(r.integers(1, 6)))]
    rows += [(200 + d, p, rows[p][2]) for d in range(30) for p in range(2)] + [(300, 0, None), (None, 0, [0.0] * 12)]
    frame = spark.createDataFrame(rows, "doc long, p int, v array<double>").repartition(4)
    docs = late.token_vectors(frame, "doc", "p", "v")
    plain = {}
    for d, _, v in rows:
        if d is not None and v is not None:
            plain.setdefault(d, []).append(np.array(v))
    plain = sorted(plain.items())
    queries = [x for x in plain if x[0] % 10 == 0]
    for k, size in ((3, 16_384), (40, 20)):
        got = late.max_sim(docs, docs.where("doc_id % 10 = 0"), k, doc_block=size, query_block=7).collect()
        want = brute(plain, queries, k)
        assert [(a.query_id, a.rank, a.doc_id) for a in sorted(got)] == [x[:3] for x in want]
        assert np.allclose([a.score for a in sorted(got)], [x[3] for x in want])
    assert late.max_sim(docs.limit(0), docs.limit(0), 3).collect() == []


def test_bounds_leave_documents_unmeasured():
    r = np.random.default_rng(4)
    first = np.arange(0, 4001, 4)
    centre = np.repeat(r.normal(0, 5, (1000, 8)), 4, 0)
    vectors = centre + r.normal(0, 0.1, (4000, 8))
    query = vectors[:3]
    at, scores, measured = late.best_of_block(vectors, first, np.arange(1000), query, 5)
    full = np.maximum.reduceat(vectors @ query.T, first[:-1]).sum(1)
    assert at == np.argsort(-full, kind="stable")[:5].tolist() and measured < 200
