"""Registered queries on small tables of their own, against brute force."""

import pytest

from lodestar.queries import QUERIES, QUERY_TERMS


def write(spark, root, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_rerank_reads_whole_texts(spark, tmp_path):
    long = "lorem " * 100
    texts = [f"thand {long}", f"{long}\n{long}ering", f"thand {long}{long}keit eaux\nering", f"{'x' * 399} eaux keit", f"ering {'y' * 300} thand {long}\n{long}eaux {long}keit"]
    texts += [f"{long}{QUERY_TERMS[i % 4]} {long}" for i in range(30)] + [long] * 20
    d = write(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"), embeddings=([(7, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    got = {r.path: r.score for r in QUERIES["rerank_standin"](spark, d).collect()}
    assert len(got) == 20 and {0, 1, 2, 3, 4} <= set(got)
    assert got == {i: len(set(QUERY_TERMS) & set(texts[i].split())) / 4 for i in got}
    assert got[4] == 1.0


def test_phase_merge_covers_whole_tables(spark, tmp_path):
    docs = [(i, "x", 10 + i) for i in range(12)]
    events = [(j, j % 15, "click" if j % 2 else "view") for j in range(40)]
    vectors = [(i, [1.0, 2.0]) for i in range(5, 20)]
    d = write(spark, tmp_path, documents=(docs, "doc_id long, text string, n_chars long"), events=(events, "event_id long, user_id long, event_type string"), embeddings=(vectors, "vec_id long, embedding array<float>"))
    last = {user: kind for _, user, kind in events}
    want = sorted((k, 10 + k if k < 12 else None, last[k], 2 if k >= 5 else None) for k in range(15))
    assert sorted(tuple(r) for r in QUERIES["phase_merge_whole"](spark, d).collect()) == want


def test_calls_of_the_whole_graph(spark, tmp_path):
    orders = [(1, 2, 3), (3, 1), (4, 2, 2, 1), (2, 4), (3, 2)]
    items = [(o, k + 1, p) for o, parts in enumerate(orders) for k, p in enumerate(parts)]
    edges = {(a, b) for parts in orders for a, b in zip(parts, parts[1:]) if a != b}
    assert (3, 1) in edges and (1, 2) in edges and (2, 3) in edges  # a cycle
    d = write(spark, tmp_path, lineitem=(items, "l_orderkey long, l_linenumber int, l_partkey long"), part=([(i,) for i in range(1, 5)], "p_partkey long"))
    counts = {n: sum(b == n for _, b in edges) for n in range(1, 5)}
    order = sorted(counts, key=lambda n: (-counts[n], n))
    assert sorted(tuple(r) for r in QUERIES["in_degree_rank_whole"](spark, d).collect()) == sorted((n, counts[n], order.index(n) + 1) for n in counts)
    scores = dict.fromkeys(counts, 0.25)
    for _ in range(10):
        scores = {n: 0.15 / 4 + 0.85 * sum(scores[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n) for n in scores}
    got = {r.node: r.score for r in QUERIES["pagerank_10_iters_whole"](spark, d).collect()}
    assert got == pytest.approx(scores, abs=1e-8) and sum(got.values()) == pytest.approx(1, abs=1e-8)
