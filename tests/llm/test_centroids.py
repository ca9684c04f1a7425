import hashlib
import math
import random

import numpy as np

from lodestar.llm.centroids import clusters, nearest
from lodestar.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k=16, rounds=3, dims=64):
    bound = lambda n: max(-(2**63), min(2**63 - 1, n))
    kept = [(i, [bound(math.floor(64 * x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    c = [v for _, v in sorted(kept, key=lambda x: (hashlib.sha256(f"1:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), a in zip(kept, at, strict=True) if a == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c[j] for j, g in enumerate(groups)]
    return sorted([(i, near(v)[1], bound(near(v)[0])) for i, v in kept], key=repr), c


def run(spark, rows, **kw):
    found, c = clusters(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3), **kw)
    return sorted((tuple(r) for r in found.collect()), key=repr), c.tolist()


def test_against_brute_force_with_odd_rows(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(m, 0.3) for _ in range(64)]) for i, m in zip(range(300), [r.choice([-1, 0, 0.5, 2]) for _ in range(300)], strict=True)]
    rows += [(i, [0.25] * 64) for i in range(400, 440)] + [(i, [-0.25] * 64) for i in range(440, 460)]  # ties
    rows += [(500, None), (501, [None] + [0.0] * 63), (502, [float("nan")] * 64), (503, [float("-inf")] + [0.0] * 63), (504, [1.0]), (505, []), (506, [0.0] * 65), (None, [0.1] * 64), (7, rows[8][1]), (7, rows[8][1])]
    assert run(spark, rows) == brute(rows)


def test_more_equal_rows_than_centroids_and_few_rows(spark):
    rows = [(i, [0.5] * 64) for i in range(50)]  # all but one centroid stay empty
    got, c = run(spark, rows)
    assert (got, c) == brute(rows) and {x[1] for x in got} == {0}
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == ([], [])


def test_huge_components_stay_exact(spark):
    r = random.Random(9)
    rows = [(i, [r.choice([-1, 1]) * 10.0 ** r.randrange(0, 14) for _ in range(64)]) for i in range(60)] + [(60, [1e300] * 64), (61, [-1e300] * 64)]
    assert run(spark, rows) == brute(rows)


def test_partial_distances_give_the_nearest_of_all():
    r = np.random.default_rng(1)
    for dims in (1, 7, 8, 9, 64):
        v, c = r.integers(-3, 4, (500, dims)), r.integers(-3, 4, (16, dims))
        full = ((v[:, None] - c[None]) ** 2).sum(2)
        cluster, distance = nearest(v, c, r.permutation(dims))
        assert cluster.tolist() == full.argmin(1).tolist() and distance.tolist() == full.min(1).tolist()


def test_registered_query(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, c = brute(rows)
    out = [r.asDict() for r in QUERIES["op13_centroids"](spark, str(tmp_path)).collect()]
    assert sorted(((x["vec_id"], x["cluster"], x["distance"]) for x in out), key=repr) == want
    inertia = {k: sum(d for _, j, d in want if j == k) for k in range(16)}
    for x in out:
        assert x["cluster_inertia"] == inertia[x["cluster"]] and x["inertia"] == sum(inertia.values())
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[x["cluster"]])).encode()).hexdigest()
