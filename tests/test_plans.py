import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar import cli, models, tools
from lodestar.operators.lexical import LexicalIndex
from lodestar.plans import corpus, phases
from lodestar.plans.search import HybridSearch, SearchConfig
from lodestar.sources import catalog, files
from lodestar.streaming.incremental import event_counts, process_new

SOURCES = {
    "order/CustomerOrder.plsql": "-- 240115  ABCD    Added credit check\nPROCEDURE Check_Credit (x_ IN NUMBER) IS\n   Invoice_API.Post(x_);\n   customer credit limit is validated here\n",
    "inv/Invoice.plsql": "-- 240116  ABCD    Posting of invoices\nPROCEDURE Post (x_ IN NUMBER) IS\n   Ledger_API.Book(x_);\n   invoice posting and rounding of totals\n",
    "fin/Ledger.plsql": "FUNCTION Book RETURN NUMBER IS\n   ledger booking of vouchers\n",
    "fin/Broken.plsql": None,
}
#: More files, so that both sides of a search find several.
MORE = {
    "order/CustomerCredit.plsql": "-- 240117  ABCD    Credit limit of a customer\nPROCEDURE Raise_Limit (x_ IN NUMBER) IS\n   customer credit validation of the limit\n",
    "order/CustomerInfo.plsql": "-- 240118  ABCD    Customer address\nPROCEDURE Print_Info (x_ IN NUMBER) IS\n   the customer and its address\n",
    "pay/Payment.plsql": "-- 240119  ABCD    Payments\nPROCEDURE Pay (x_ IN NUMBER) IS\n   payment validation against credit\n",
    "inv/Stock.plsql": "-- 240120  ABCD    Stock levels\nPROCEDURE Count_Stock (x_ IN NUMBER) IS\n   stock of parts in places\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for name, body in SOURCES.items():
        path = root / "versions" / "25.1" / "source" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode() if body is not None else b"ledger \xff\xfe broken Ledger_API.Book(x)\n")
    return root


def test_source_tree_and_file_info(spark, tree):
    rows = {r.relative_path: r for r in files.file_info(files.source_tree(spark, f"{tree}/versions/25.1/source")).collect()}
    assert set(rows) == set(SOURCES)
    r = rows["order/CustomerOrder.plsql"]
    assert (r.file_name, r.api_name, r.api_calls, r.changelog_lines, r.procedure_function_names) == ("CustomerOrder.plsql", "Customer_Order_API", ["INVOICE_API"], ["Added credit check"], ["PROCEDURE CHECK_CREDIT"])
    assert r.file_size_mb == pytest.approx(len(SOURCES["order/CustomerOrder.plsql"]) / 1048576)
    broken = files.source_tree(spark, f"{tree}/versions/25.1/source").where("relative_path = 'fin/Broken.plsql'").first()
    assert broken.content == "ledger  broken Ledger_API.Book(x)\n"
    assert [x.relative_path for x in files.source_tree(spark, f"{tree}/versions/25.1/source", max_files=2).collect()] == ["fin/Broken.plsql", "fin/Ledger.plsql"]
    with pytest.raises(ValueError):
        files.source_tree(spark, f"{tree}/versions/25.1/source", suffix=".client")


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    root = tmp_path_factory.mktemp("large")
    for name, body in (SOURCES | MORE).items():
        path = root / "versions" / "25.1" / "source" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode() if body is not None else b"ledger \xff\xfe broken Ledger_API.Book(x)\n")
    return root


def test_build_and_search(spark, large):
    tree = large
    paths = catalog.Paths.of(str(tree), "25.1")
    totals = corpus.build(spark, paths.source, paths, models.hashing_embedder, models.first_line_summariser).first()
    assert (totals.total, totals.successful, totals.summarised, totals.embedded) == (8, 8, 8, 8)
    status = catalog.versions(str(tree))[0]
    assert status.is_ready and status.has_full_analysis and status.has_vectors and status.file_count == 8
    assert catalog.version_table(spark, str(tree)).count() == 1
    ranked = files.read_ranked(spark, paths.ranked).orderBy("pagerank_rank").collect()
    assert ranked[0].relative_path == "fin/Ledger.plsql" and [r.pagerank_rank for r in ranked] == list(range(1, 9))
    assert files.read_analysis(spark, paths.analysis).count() == 8
    assert LexicalIndex.read(spark, paths.lexical) is not None
    engine = cli.engine(spark, paths, None)
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = engine.search(lexical_query="invoice", top_k=5, config=SearchConfig.slow_hardware())
    top = found.results.collect()
    assert top[0].path == "inv/Invoice.plsql" and found.fusion_method == "pagerank_lexical_only" and found.vector_count == 0
    assert top[0].snippet == "-- 240116  ABCD    Posting of invoices" and "Exact match" in top[0].explanation
    hybrid = engine.search("customer credit validation", top_k=4)
    assert hybrid.rerank_applied and hybrid.query_type == "mixed" and hybrid.results.count() <= 4
    assert hybrid.results.select("path").distinct().count() == hybrid.results.count() >= 2
    assert hybrid.lexical_count >= 3 and hybrid.vector_count >= 3 and all("reranked" in r.source for r in hybrid.results.collect())
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= cached  # a search leaves nothing cached
    full = engine.search("customer credit", top_k=4, fill_quota=True, config=SearchConfig.medium_hardware())
    assert full.fusion_method == "pagerank_weighted" and full.results.count() >= hybrid.results.count() - 1
    assert "CustomerOrder" in tools.search_codebase(engine, "credit", max_results=3)
    assert "Invoice" in tools.search_lexical(engine, "posting") and tools.search_semantic(engine, "ledger")
    assert tools.search_codebase(engine, "x", search_mode="odd").startswith("unknown") and tools.development_guidance()


def test_build_resumes(spark, tmp_path):
    source = tmp_path / "versions/1.0/source"
    source.mkdir(parents=True)
    paths = catalog.Paths.of(str(tmp_path), "1.0")
    for n in ("One", "Two"):
        (source / f"{n}.plsql").write_text(f"-- 240101  ABCD    {n} is here\n")
    (tmp_path / "seen").mkdir()
    seen = str(tmp_path / "seen")

    def summariser():
        def f(texts):
            for t in texts:
                with open(f"{seen}/log", "a") as file:
                    file.write(t)
                if "bad" in t and not os.path.exists(f"{seen}/mended"):
                    raise RuntimeError("not now")
            return [t.strip() for t in texts]

        return f

    corpus.build(spark, paths.source, paths, models.hashing_embedder, summariser)
    (source / "Three.plsql").write_text("bad\n")
    first = corpus.build(spark, paths.source, paths, models.hashing_embedder, summariser).first()
    assert (first.total, first.successful, first.embedded) == (3, 2, 2)
    open(f"{seen}/mended", "w").close()
    second = corpus.build(spark, paths.source, paths, models.hashing_embedder, summariser).first()
    assert (second.total, second.successful, second.embedded) == (3, 3, 3)
    done = open(f"{seen}/log").read()
    assert done.count("One is here") == done.count("Two is here") == 1 and done.count("bad") >= 2
    assert spark.read.parquet(paths.vectors).count() == 3


def test_hostile_archives_are_refused(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["--data", str(tmp_path / "data"), *a], spark)
    for name in ("checkout/../../../../escaped.plsql", "checkout//etc/x.plsql", "checkout/C:/x.plsql", "checkout/a\\..\\b.plsql", "/abs/x.plsql", "checkout/./x.plsql", "../x.plsql"):
        archive = tmp_path / "evil.zip"
        with zipfile.ZipFile(archive, "w") as z:
            z.writestr("checkout/a/Good.plsql", "x")
            info = zipfile.ZipInfo("x")
            info.filename = name
            z.writestr(info, "x")
        assert run("import", str(archive), "--version", "1.0") == 1, name
        assert "unsafe name" in capsys.readouterr().err
        assert not list(tmp_path.rglob("*.plsql")), name


def test_import_replaces_the_old_extraction(spark, tmp_path):
    run = lambda *a: cli.main(["--data", str(tmp_path), *a], spark)
    for name in ("Old", "New"):
        with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
            z.writestr(f"checkout/a/{name}.plsql", "x")
        assert run("import", str(tmp_path / "r.zip"), "--version", "1.0") == 0
    assert [p.name for p in (tmp_path / "versions/1.0").rglob("*") if p.is_file() and not p.name.startswith(".")] == ["New.plsql"]


def test_unreadable_files_are_left_out(spark, tmp_path):
    (tmp_path / "A.plsql").write_text("x")
    (tmp_path / "B.plsql").symlink_to(tmp_path / "gone")
    assert [r.file_name for r in files.source_tree(spark, str(tmp_path)).collect()] == ["A.plsql"]


def test_progress_is_saved_and_loaded(spark, tmp_path):
    log = spark.createDataFrame([("r", "2024-01-01 00:00:00", True), ("r", "2024-01-01 00:00:10", False)], "run string, timestamp string, success boolean")
    path = str(tmp_path / "progress")
    assert phases.load_progress(spark, path) is None
    row = phases.progress(log, total=4)
    phases.save_progress(row, path)
    assert phases.load_progress(spark, path).first().asDict() == row.select(*phases.load_progress(spark, path).columns).first().asDict()


def test_simplified_list(spark, tree):
    rows = corpus.simplified(spark, f"{tree}/versions/25.1/source", max_files=3).collect()
    assert [(r.rank, r.relative_path) for r in rows] == [(1, "fin/Broken.plsql"), (2, "fin/Ledger.plsql"), (3, "inv/Invoice.plsql")]
    assert rows[2].api_calls == ["Ledger_API.Book"] and rows[2].api_name == "INVOICE_API"


def test_package_and_download(spark, large, tmp_path, capsys):
    assert cli.main(["--data", str(large), "package", "25.1"], spark) == 0
    made = json.loads(capsys.readouterr().out)
    names = zipfile.ZipFile(made["path"]).namelist()
    assert "README.txt" in names and not any(n.startswith(("source", "contents", "analysis")) for n in names) and made["files"] == len(names) - 1
    assert made["smaller_by_percent"] == pytest.approx((1 - made["size"] / made["original_size"]) * 100)
    (tmp_path / "releases.json").write_text(json.dumps([{"tag_name": "x", "assets": []}, {"tag_name": "y", "assets": [{"name": "25.1.zip", "browser_download_url": f"file://{made['path']}"}]}]))
    assert cli.main(["--data", str(tmp_path), "download", "25.1", "--releases", str(tmp_path / "releases.json")], spark) == 0
    assert catalog.versions(str(tmp_path))[0].is_ready
    assert cli.main(["--data", str(tmp_path), "download", "9.9", "--releases", str(tmp_path / "releases.json")], spark) == 1


def test_lazy_engine():
    made = []
    lazy = tools.LazyEngine(lambda: made.append(1) or "engine", prewarm_after=0.01)
    import time

    time.sleep(0.3)
    assert made == [1] and lazy.get() == "engine" and made == [1]
    slow = tools.LazyEngine(lambda: 1 / 0, prewarm_after=None)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            slow.get()


def test_files_by_extension(spark, tree):
    rows = files.count_by_extension(files.file_listing(spark, f"{tree}/versions")).collect()
    assert [(r.version, r.extension, r.n) for r in rows] == [("25.1", ".plsql", 4)]


def test_command_line(spark, tree, tmp_path, capsys):
    archive = tmp_path / "release.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("checkout/fndbas/source/version.txt", "# comment\n\n25.2.0 build 7\n")
        z.writestr("checkout/a/B.PLSQL", "x")
        z.writestr("checkout/a/c.txt", "x")
        z.writestr("other/d.plsql", "x")
    run = lambda *a: cli.main(["--data", str(tmp_path), *a], spark)
    assert run("import", str(archive)) == 0
    assert os.listdir(tmp_path / "versions/25.2.0/source/a") == ["B.PLSQL"]
    capsys.readouterr()
    assert run("list", "--json") == 0
    assert [s["version"] for s in json.loads(capsys.readouterr().out)] == ["25.2.0"]
    assert run("analyze", "--version", "25.2.0") == 1  # no file with the suffix in lower case
    assert run("delete", "25.2.0", "--force") == 0 and run("delete", "25.2.0", "--force") == 1
    assert cli.main(["--data", str(tree), "calculate-pagerank", "--version", "25.1", "--max-iterations", "3"], spark) == 0


def test_catalog(tmp_path):
    assert catalog.safe_name("25.1 β/x") == "25.1βx"
    with pytest.raises(ValueError):
        catalog.safe_name("/ /")
    (tmp_path / "a" / "b" / "fndbas").mkdir(parents=True)
    (tmp_path / "a" / "b" / "order").mkdir()
    assert catalog.work_root(str(tmp_path)).endswith("/a/b")
    (tmp_path / "z").mkdir()
    with pytest.raises(ValueError):
        catalog.work_root(str(tmp_path))
    releases = [{"tag_name": "1", "assets": [{"name": "25.1.0-lexical.zip"}]}, {"tag_name": "2", "assets": [{"name": "5.1.0-lexical.zip"}, {"name": "5.1.0-vectors.zip"}]}, {"tag_name": "3", "assets": [{"name": "25.1.0.zip"}]}]
    assert catalog.matching_release(releases, "25.1.0")["tag_name"] == "3" and catalog.matching_release(releases, "5.1.0")["tag_name"] == "2"


def test_archive_without_version(tmp_path):
    path = tmp_path / "x.zip"
    path.write_bytes(b"")
    with zipfile.ZipFile(io.BytesIO(), "w"):
        pass
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", "b")
    with pytest.raises(ValueError):
        files.archive_version(str(path))


def test_releases_and_artifacts(spark):
    tags = spark.createDataFrame([("v1.10.0",), ("1.9.9",), ("v2.0",), ("v1.9.10",)], "tag string")
    assert sorted(r.tag for r in files.newer_release(tags, "v1.9.9").collect()) == ["v1.10.0", "v1.9.10"]
    listing = spark.createDataFrame([("v/lexical/index",), ("v/vectors/e.npy",), ("v/ranked.jsonl",), ("v/source/a.plsql",)], "path string")
    assert files.publishable(listing).count() == 3


def test_summaries_resume_and_keep_errors(spark):
    def make():
        def f(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [t.upper() for t in texts]

        return f

    tree = spark.createDataFrame([("a", "one"), ("b", "bad"), ("c", "three")], "relative_path string, content string")
    first = {r.path: r for r in corpus.summaries(tree, None, make).collect()}
    assert first["a"].summary == "ONE" and not first["b"].success and first["b"].error_message == "no"
    log = spark.createDataFrame([("a", True), ("b", False)], "path string, success boolean")
    assert {r.path for r in corpus.summaries(tree, log, make).collect()} == {"b", "c"}


def test_progress(spark):
    log = spark.createDataFrame([("r", "2024-01-01 00:00:00", True), ("r", "2024-01-01 00:00:10", False)], "run string, timestamp string, success boolean").withColumn("timestamp", F.to_timestamp("timestamp"))
    r = phases.progress(log, total=4).first()
    assert (r.files_processed, r.files_successful, r.files_failed, r.current_rate, r.success_rate) == (2, 1, 1, 0.2, 0.5)
    assert str(r.estimated_completion) == "2024-01-01 00:00:20"


def test_stream_processes_each_file_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(5).coalesce(1).write.parquet(src)
    run = lambda: process_new(spark, src, spark.range(1).schema, lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(8))


def test_windows_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:04:00", "a", 2.0), ("2024-01-01 00:06:00", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    q = event_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.event_type, r.n, r.value) for r in spark.sql("select * from windows").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_search_without_vectors(spark):
    docs = spark.createDataFrame([("p", "f.plsql", "F_API", 1, "alpha beta gamma delta")], "path string, file_name string, api_name string, rank int, content string")
    from lodestar.operators import lexical

    index = lexical.build_index(spark.createDataFrame([("p", ["alpha", "beta"])], "doc_id string, tokens array<string>"))
    r = HybridSearch(docs, index).search("alpha", top_k=3, config=SearchConfig.slow_hardware())
    assert [x.path for x in r.results.collect()] == ["p"] and r.total_found == 1
    assert HybridSearch(docs, index).search("nothing", config=SearchConfig.slow_hardware()).markdown() == "No results for: nothing"
