"""The analysis document: written and read in parallel, one JSON document when its parts are joined."""

import json
import os

from lodestar.schemas import FILE_INFO
from lodestar.sources import files

ROWS = [(f"/t/m{i % 3}/F{i}.plsql", f"m{i % 3}/F{i}.plsql", f"F{i}.plsql", f"F{i}_API", i / 8, [f"G{j}_API" for j in range(i % 4)], [f'note "{i}"\n, {{x}}'] * (i % 2), None) for i in range(120)]


def written(spark, tmp_path, rows, links):
    path = str(tmp_path / "analysis")
    files.write_analysis(spark.createDataFrame(rows, FILE_INFO), spark.createDataFrame(links, "src string, targets array<string>"), path, '/t "x"')
    return path


def joined(path):
    return "".join(open(f"{path}/{n}", encoding="utf-8").read() for n in sorted(os.listdir(path)) if n.startswith("part-"))


def test_document_is_whole_and_read_in_parallel(spark, tmp_path):
    links = [(r[1], r[5]) for r in ROWS]
    path = written(spark, tmp_path, ROWS, links)
    assert sum(n.startswith("part-") for n in os.listdir(path)) > 1
    doc = json.loads(joined(path))
    order = sorted(ROWS, key=lambda r: r[1])
    assert [(f["relative_path"], f["file_order"], f["file_size_mb"], f["api_calls"], f["changelog_lines"]) for f in doc["file_info"]] == [(r[1], i, r[4], r[5], r[6]) for i, r in enumerate(order)]
    assert doc["reference_graph"] == dict(links) and list(doc["reference_graph"]) == sorted(dict(links))
    assert doc["analysis_metadata"]["work_directory"] == '/t "x"' and doc["analysis_metadata"]["processing_stats"]["total_api_calls_found"] == sum(len(r[5]) for r in ROWS)
    single = str(tmp_path / "one.json")
    assert files.single_file(spark, path, single) == os.path.getsize(single) == len(joined(path).encode())
    assert json.load(open(single)) == doc
    for place in (path, single):
        got = files.read_analysis(spark, place)
        assert [tuple(r)[1:] for r in got.orderBy("file_order").collect()] == [tuple(r) for r in order]
        assert sorted((r.src, r.targets) for r in files.read_links(spark, place).collect()) == sorted(links)
    assert "MapPartitions" not in got._jdf.queryExecution().toString() and "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.relative_path for r in files.read_analysis(spark, path, max_files=3).collect()] == [r[1] for r in order[:3]]


def test_other_documents_and_empty_ones(spark, tmp_path):
    other = tmp_path / "other.json"
    other.write_text(json.dumps({"file_info": [{"relative_path": "b"}, {"relative_path": "a", "api_calls": ["X_API"]}], "reference_graph": {"a": ["b"]}}, indent=1))
    got = files.read_analysis(spark, str(other)).orderBy("file_order").collect()
    assert [(r.file_order, r.relative_path, r.api_calls) for r in got] == [(0, "b", None), (1, "a", ["X_API"])]
    assert [(r.src, r.targets) for r in files.read_links(spark, str(other)).collect()] == [("a", ["b"])]
    path = written(spark, tmp_path, [], [])
    assert json.loads(joined(path))["file_info"] == [] and json.loads(joined(path))["reference_graph"] == {}
    assert files.read_analysis(spark, path).collect() == [] and files.read_links(spark, path).collect() == []
    path = written(spark, tmp_path, ROWS[:1], [("x", None)])
    assert json.loads(joined(path))["reference_graph"] == {"x": []}


def test_ranked_lines_are_in_rank_order(spark, tmp_path):
    path = str(tmp_path / "ranked.jsonl")
    ranked = spark.createDataFrame([(f"f{i}", float(i), 300 - i) for i in range(300)], "relative_path string, pagerank_score double, pagerank_rank int")
    files.write_ranked(ranked, path)
    lines = joined(path).splitlines()
    assert [json.loads(x)["pagerank_rank"] for x in lines] == list(range(1, 301))
    assert files.read_ranked(spark, path).count() == 300 and sum(n.startswith("part-") for n in os.listdir(path)) > 1
