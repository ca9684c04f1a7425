"""The stored index in blocks, against the tables it was made from."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import lexical

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    r = random.Random(11)
    docs = [(f"d{i:04d}", r.choices(WORDS, [1 / (n + 1) for n in range(len(WORDS))], k=r.randrange(0, 30))) for i in range(1500)]
    docs += [(f"copy{i}", docs[3][1]) for i in range(40)] + [("none", []), ("rare", ["once", "w1", "w1"])]
    plain = lexical.build_index(spark.createDataFrame(docs, "doc_id string, tokens array<string>"))
    path = str(tmp_path_factory.mktemp("lexical") / "index")
    plain.write(path, buckets=5, slice_docs=8)
    return plain, lexical.LexicalIndex.read(spark, path), docs


def found(index, queries, k, **kw):
    return sorted(tuple(r) for r in lexical.search_batch(index, queries, k, **kw).select("query_id", "rank", "doc_id", "score").collect())


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, terms array<string>")


def test_search_equals_the_plain_tables(spark, indexes, monkeypatch):
    plain, stored, docs = indexes
    r = random.Random(2)
    rows = [(0, ["once"]), (1, ["w0"]), (2, ["w1", "w1", "once", "nowhere"]), (3, ["nowhere"]), (4, []), (5, docs[3][1])]
    rows += [(10 + i, r.choices(WORDS, k=r.randrange(1, 6))) for i in range(30)]
    for k in (1, 7, 100):
        want = found(plain, asked(spark, rows), k)
        assert found(stored, asked(spark, rows), k) == want and len(want) > 30 * min(k, 5)
        with monkeypatch.context() as m:  # more pairs than the driver takes: one join reads every block
            m.setattr(lexical, "PRUNED_TERMS", 3)
            assert found(stored, asked(spark, rows), k) == want
    assert found(stored, asked(spark, rows[:1]), 5) == found(plain, asked(spark, rows[:1]), 5)
    assert found(stored, asked(spark, [(3, ["nowhere"])]), 5) == found(stored, asked(spark, []), 5) == []
    assert found(stored, asked(spark, rows[:3]), 3, positive=False) == found(plain, asked(spark, rows[:3]), 3, positive=False)


def test_bounds_leave_slices_out(spark, indexes):
    _, stored, _ = indexes
    few = spark.createDataFrame([(0, "once", 1), (0, "w1", 1), (1, "w30", 1)], "query_id int, term string, times long")
    blocks = stored.blocks.join(F.broadcast(few), "term")
    every = blocks.select("query_id", "slice").distinct().groupBy("query_id").count().collect()
    kept = {r["query_id"]: r["count"] for r in stored.promising(blocks, 1).groupBy("query_id").count().collect()}
    assert kept[0] == 1 and all(1 <= kept[r["query_id"]] <= r["count"] for r in every)
    assert kept[1] < next(r["count"] for r in every if r["query_id"] == 1)


def test_blocks(spark, indexes):
    plain, stored, docs = indexes
    assert stored.n == len(docs) and stored.slice_docs == 8
    one = stored.blocks.agg(F.max(F.size("places")), F.count("*"), F.sum(F.size("places"))).first()
    assert one[0] <= 8 and one[2] == plain.postings.count() > one[1]
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(stored.postings) == rows(plain.postings.select("term", "doc_id", "tf", "dl"))
    assert rows(stored.terms) == rows(plain.terms)
    assert rows(stored.docs.select("doc_id", "dl")) == rows(plain.docs)


def read_records(spark, frame):
    """Rows that the scans of a frame's plan have put out."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame.collect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_scan_reads_the_pages_of_its_terms(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.array(*[F.concat(F.lit(f"t{i}_"), F.pmod(F.hash("id", F.lit(i)), F.lit(2000)).cast("string")) for i in range(8)]).alias("tokens"))
    lexical.build_index(docs).write(str(tmp_path / "x"), buckets=2, slice_docs=64)
    stored = lexical.LexicalIndex.read(spark, str(tmp_path / "x"))
    total = stored.blocks.count()
    read = read_records(spark, stored.blocks.where(F.col("term").isin("t3_77", "t5_1999")))
    assert total > 20_000 and 0 < read < 0.01 * total


def test_terms_are_counted_without_an_exchange(spark):
    from collections import Counter

    r = random.Random(5)
    rows = [(i, r.choices(["a", "b", "É", "", "zz"], k=r.randrange(0, 12))) for i in range(60)] + [(100, None), (101, []), (102, ["x", None, "x", None])]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, tokens array<string>"))
    want = sorted((t, i, n, len(ts)) for i, ts in rows if ts for t, n in Counter(x for x in ts if x is not None).items())
    assert sorted(tuple(x) for x in index.postings.collect()) == want
    assert sorted(tuple(x) for x in index.docs.collect()) == [(i, len(ts or [])) for i, ts in rows]
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    assert index.stats.first().n == 63


def test_blocks_are_exchanged_once_and_grouped_before(spark):
    """What lies in one slice is one row before the exchange, whatever a document's length; slices do not leave their
    partition."""
    rows = [(i, ["a"] * (40_000 if i == 5 else 2) + ["b", f"t{i}"]) for i in range(50)]
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3))
    placed = lexical.in_slices(index.counted, 10)
    assert "Exchange" not in "".join(x for x in placed._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(doc_id" in x)
    assert placed.groupBy("slice").agg(F.count("*").alias("n"), F.countDistinct("place").alias("d")).where("n <> d or n > 10").count() == 0
    packed = lexical.blocks(placed, 804.0)
    slices = placed.select("slice").distinct().count()
    assert packed.where("term in ('a', 'b')").count() == 2 * slices and packed.where("wide IS NOT NULL").count() == 3
    plan = lexical.unpacked(packed).groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [term" not in plan and "Join" not in plan.split("MapInArrow")[0]
    got = {(r.term, r.tf, r.dl) for r in lexical.unpacked(packed).where("term = 'a'").select("term", F.explode(F.arrays_zip("tfs", "dls")).alias("p")).select("term", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")).collect()}
    assert got == {("a", 2, 4), ("a", 40_000, 40_002)}


def test_ties_go_to_the_smaller_id_wherever_documents_lie(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:03d}", ["x", "y"]) for i in range(99, -1, -1)], "doc_id string, tokens array<string>").repartition(7)
    lexical.build_index(docs).write(str(tmp_path / "x"), buckets=3, slice_docs=8)
    stored = lexical.LexicalIndex.read(spark, str(tmp_path / "x"))
    assert [r[2] for r in found(stored, asked(spark, [(0, ["x"])]), 4)] == ["d000", "d001", "d002", "d003"]
    assert stored.terms.select("term", "df").orderBy("term").collect() == [("x", 100), ("y", 100)]


def test_a_large_slice_lies_in_parts(monkeypatch):
    """A slice with more postings than a task holds gives a term several blocks."""
    monkeypatch.setattr(lexical, "HELD_POSTINGS", 12)
    batches = [lexical.pa.RecordBatch.from_pydict({"slice": lexical.pa.array([s] * 4, lexical.pa.int32()), "place": lexical.pa.array(range(p, p + 4), lexical.pa.int16()), "dl": lexical.pa.array([3] * 4, lexical.pa.int32()), "terms": [["a", "b", "c"]] * 4, "tfs": lexical.pa.array([[1, 1, 1]] * 4, lexical.pa.list_(lexical.pa.int32()))}) for s, p in ((0, 0), (0, 4), (0, 8), (0, 12), (1, 0), (2, 0), (2, 4))]
    out = [r for b in lexical.in_blocks(iter(batches), 3.0) for r in b.to_pylist()]
    assert sum(len(r["x"]) for r in out) == 3 * 3 * 4 * 7
    assert sum(r["term"] == "a" for r in out if r["slice"] == 0) == 2 and sum(r["term"] == "a" for r in out if r["slice"] == 2) == 1


def test_many_pairs_are_scored_where_slices_lie(spark, indexes):
    """What is exchanged is blocks, by their slices; no sum per query and document is, and no block per query."""
    plain, stored, _ = indexes
    rows = [(i, [f"w{(i + j) % 40}" for j in range(10)]) for i in range(60)]
    assert found(stored, asked(spark, rows), 5) == found(plain, asked(spark, rows), 5)
    plan = stored.scored_in_slices(lexical._asked(asked(spark, rows)), True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in "".join(x for x in plan.splitlines() if "place" in x) and "Exchange hashpartitioning(slice" in plan
