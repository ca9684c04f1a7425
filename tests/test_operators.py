import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import fusion, graph, lexical, signals, vector
from lodestar.plans import phases
from lodestar.plans.search import SearchConfig


def test_pagerank_steps(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "src string, dst string")
    want = {1: (0.05, 0.1916667, 0.475), 2: (0.05, 0.07125, 0.2341667), 3: (0.05, 0.07125, 0.1318125)}
    for n, values in want.items():
        got = {r.node: r.score for r in graph.pagerank(nodes, edges, iterations=n, tolerance=None).collect()}
        assert [got[k] for k in "ABC"] == pytest.approx(values, abs=1e-6)
    final = {r.node: r.score for r in graph.pagerank(nodes, edges).collect()}
    assert sum(final.values()) == pytest.approx(0.2530625)
    spread = graph.pagerank(nodes, edges, redistribute=True, iterations=6, tolerance=None).agg(F.sum("score")).first()[0]
    assert spread == pytest.approx(1.0)
    assert graph.pagerank(nodes.limit(0), edges).count() == 0


def test_edges_last_file_wins(spark):
    rows = [("a", "Cust_API", ["ORD_API", "NONE_API", "CUST_API"], 1), ("b", "Ord_API", [], 2), ("c", "ORD_API", ["CUST_API"], 3)]
    files = spark.createDataFrame(rows, "relative_path string, api_name string, api_calls array<string>, file_order int")
    edges = graph.reference_edges(files)
    assert sorted(map(tuple, edges.collect())) == [("a", "c"), ("c", "a")]
    nodes = files.select(F.col("relative_path").alias("node"))
    assert {r.node: r.reference_count for r in graph.in_degrees(nodes, edges).collect()} == {"a": 1, "b": 0, "c": 1}
    assert {r.src: r.targets for r in graph.reference_graph(nodes, edges).collect()} == {"a": ["c"], "b": [], "c": ["a"]}
    assert tuple(graph.unlinked(nodes, edges).first()) == (1, 1)


def test_bm25_fixture(spark, tmp_path):
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "a", "c"]), (2, ["c"])], "doc_id long, tokens array<string>")
    index = lexical.build_index(docs)
    index.write(str(tmp_path / "index"), buckets=2)
    index = lexical.LexicalIndex.read(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, ["a"]), (2, ["a", "a"]), (3, ["zz"])], "query_id int, terms array<string>")
    got = {(r.query_id, r.doc_id): (r.score, r.rank) for r in lexical.search_batch(index, queries, 5).collect()}
    assert got[(1, 0)] == (pytest.approx(0.188001, abs=1e-6), 2) and got[(1, 1)] == (pytest.approx(0.231386, abs=1e-6), 1)
    assert got[(2, 1)][0] == pytest.approx(2 * 0.231386, abs=1e-6) and len(got) == 4
    assert [(r.doc_id, round(r.score, 6)) for r in lexical.scan_search(docs, ["a"], 5).collect()] == [(1, 0.231386), (0, 0.188001)]
    assert lexical.LexicalIndex.read(spark, str(tmp_path / "none")) is None


def test_corpus_stopwords(spark):
    docs = spark.createDataFrame([(i, ["Select", "invoice"] + (["rare"] if i < 8 else [])) for i in range(10)], "doc_id long, tokens array<string>")
    assert [r.term for r in lexical.corpus_stopwords(docs).collect()] == ["invoice"]


def test_vectors(spark):
    rows = [(0, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [0.0, -1.0]), (3, None), (4, []), (5, [1.0, 2.0, 3.0]), (6, [0.0, 0.0])]
    built = vector.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r.vec_id: r.embedding for r in built.collect()}
    assert set(got) == {0, 1, 2, 6} and got[0] == pytest.approx([0.6, 0.8]) and got[6] == [0.0, 0.0]
    assert [r.vec_id for r in vector.search(built, [0.0, 1.0], 5).collect()] == [0]
    assert all(math.isclose(sum(x * x for x in v), 1) for k, v in got.items() if k != 6)


HIT = "path string, score double, source string, match_type string, explanation string"


def test_merge(spark):
    lex = spark.createDataFrame([("f1", 4.0, "lexical", "exact", "l"), ("f2", 2.0, "lexical", "exact", "l")], HIT)
    vec = spark.createDataFrame([("f2", 0.8, "vector", "semantic", "v"), ("f3", 0.6, "vector", "semantic", "v")], HIT)
    got = {r.path: (r.score, r.source, r.match_type, r.explanation) for r in fusion.merged(lex, vec).collect()}
    assert got == {"f1": (4.0, "lexical", "exact", "l"), "f2": (1.4, "hybrid", "mixed", "l + vector match"), "f3": (0.6, "vector", "semantic", "v")}
    other = {r.path: (round(r.score, 6), r.source) for r in fusion.combined(lex, vec, 0.5, 0.5).collect()}
    assert other == {"f1": (0.5, "lexical"), "f2": (0.5, "hybrid"), "f3": (0.375, "vector")}


def test_boost(spark):
    hits = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0), ("d", 2.0)], "path string, score double")
    ranked = spark.createDataFrame([("a", "x/a", 0.25), ("c", None, 7.0), (None, "d", -1.0)], "relative_path string, file_path string, pagerank_score double")
    assert {r.path: r.score for r in fusion.boosted(hits, fusion.importance(ranked)).collect()} == {"a": 2.5, "b": 2.0, "c": 4.0, "d": 2.0}


@pytest.mark.parametrize(("k", "want"), [(1, [(0, 1)] * 4), (5, [(4, 1), (3, 2), (1, 4), (2, 3)]), (10, [(8, 2), (7, 3), (3, 7), (5, 5)]), (15, [(12, 3), (10, 5), (4, 11), (7, 8)]), (20, [(16, 4), (14, 6), (6, 14), (10, 10)])])
def test_quotas(k, want):
    assert [fusion.quotas(*w, k) for w in ((0.8, 0.2), (0.7, 0.3), (0.3, 0.7), (0.5, 0.5))] == want


def test_threshold_comes_after_the_cut(spark):
    hits = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "path string, score double")
    assert [r.path for r in fusion.cut(hits, 2, 2.5).collect()] == ["a"]


def test_signals(spark):
    lines = ["PROCEDURE A IS", "x := 1;", "-- note", "Error_SYS.Record_General('x');", "/* open", "SELECT inside", "still", "close */", "A_API.B(c);", "INSERT INTO t", "FUNCTION F RETURN NUMBER IS", *["y;"] * 60, "RAISE;", "RAISE EXCEPTION;"]
    files = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "file_id int, content string")
    got = {}
    for r in signals.signal_lines(files).orderBy("pos").collect():
        got.setdefault(r.signal, []).append(r.line)
    assert got["procedures"] == ["PROCEDURE A IS", "x := 1;"]
    assert got["functions"] == ["FUNCTION F RETURN NUMBER IS", *["y;"] * 49]
    assert got["comments"] == ["-- note", "/* open", "SELECT inside", "still"]
    assert got["error_messages"] == ["Error_SYS.Record_General('x');", "RAISE EXCEPTION;"]
    assert got["api_calls"] == ["A_API.B(c);"] and got["database_operations"] == ["INSERT INTO t"]
    text = signals.balanced(signals.signal_lines(files), 1000).first()["balanced"]
    assert text.startswith("\n--- ERROR MESSAGES ---\nError_SYS") and "--- DATABASE OPERATIONS ---" in text
    kept = {r.file_id: r.content for r in signals.within_context(files, limit=20, reserve=5).collect()}
    assert kept[2] == "" and kept[1] != "\n".join(lines)


def test_phases(spark):
    one = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "path string, seq int, size int")
    two = spark.createDataFrame([("b", 1, "s"), ("c", 1, "t")], "path string, seq int, summary string")
    three = spark.createDataFrame([("a", 1, 5.0), ("z", 1, 6.0)], "path string, seq int, e double")
    assert {tuple(r) for r in phases.merge(one, two, three).collect()} == {("a", 20, None, 5.0), ("b", 30, "s", None), ("c", None, "t", None)}
    log = spark.createDataFrame([("a", True), ("b", False)], "path string, success boolean")
    assert [r.path for r in phases.pending(one.select("path").distinct(), log).collect()] == ["b"]


def test_presets():
    assert SearchConfig.fast_hardware() == SearchConfig("fast_hardware", True, True, 4, 0.0)
    assert SearchConfig.medium_hardware() == SearchConfig("medium_hardware", True, False, 2, 0.0)
    assert SearchConfig.slow_hardware() == SearchConfig("slow_hardware", False, False, 1, 0.0)
    assert SearchConfig("custom", fetch_multiplier=5, min_score_threshold=0.8).fetch_multiplier == 5


def test_pagerank_counts_edges_between_nodes_only(spark):
    """A calls B and Z, which is no node: B gets all of A's share."""
    nodes = spark.createDataFrame([("A",), ("B",)], "node string")
    edges = spark.createDataFrame([("A", "B"), ("A", "Z"), ("Y", "B"), ("A", "B")], "src string, dst string")
    got = {r.node: r.score for r in graph.pagerank(nodes, edges, iterations=2, tolerance=None).collect()}
    assert got["A"] == pytest.approx(0.075) and got["B"] == pytest.approx(0.13875)


def test_top_by_calls(spark):
    files = spark.createDataFrame([("a", "A", ["x", "y"]), ("b", "B", None), ("c", "C", ["x", "z"]), ("d", "D", ["x"] * 3)], "relative_path string, file_name string, api_calls array<string>")
    assert [tuple(r) for r in graph.top_by_calls(files, 3).collect()] == [("D", 3), ("A", 2), ("C", 2)]
