"""Listings as a stream, and the index that follows them, restarts included."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import lexical
from lodestar.streaming import changes

WORDS = ["ledger", "invoice", "credit", "tax", "order", "stock"]


def content(path, hash_):
    r = random.Random(f"{path}/{hash_}")
    return " ".join(r.choices(WORDS, k=r.randrange(0, 12)))


def reader(spark, seen):
    def f(changed):
        rows = [(r.path, content(r.path, r.hash)) for r in changed.collect()]
        seen.extend(p for p, _ in rows)
        frame = spark.createDataFrame(rows, "doc_id string, content string")
        return frame.select("doc_id", text.basic_tokens(F.col("content")).alias("tokens"))

    return f


def test_index_follows_listings_over_restarts(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("listings", "table", "checkpoint"))
    r = random.Random(3)
    states = [{f"m{i % 3}/F{i}.plsql": "1" for i in range(30)}]
    for n in range(4):
        now = dict(states[-1])
        for path in r.sample(sorted(now), 4):
            del now[path]
        for path in r.sample(sorted(now), 5):
            now[path] = str(n + 2)
        now |= {f"new{n}/G{i}.plsql": "1" for i in range(3)}
        states.append(now)
    states.append({})  # everything has gone
    states.append({"back.plsql": "7"})
    listed = lambda n: changes.write_listing(spark.createDataFrame([*states[n].items(), (None, "x")], "path string, hash string"), n, folder, buckets=4)
    seen: list[str] = []

    def run(fail=False):
        make = reader(spark, seen)

        def failing(changed):
            raise RuntimeError("lost in the middle")

        changes.follow(spark, folder, table, checkpoint, failing if fail else make, buckets=4).awaitTermination()

    def same(n):
        got = {x.doc_id: x.tokens for x in changes.documents(spark, table).where("doc_id is not null").collect()}
        assert got == {p: content(p, h).split() for p, h in states[n].items()}

    listed(0)
    run()
    same(0)
    assert sorted(seen) == sorted(states[0])
    seen.clear()
    listed(1)
    with pytest.raises(Exception, match="lost in the middle"):  # a batch fails: nothing of it is seen, and it runs again
        run(fail=True)
    same(0)
    run()
    same(1)
    assert set(seen) == {p for p, h in states[1].items() if states[0].get(p) != h}  # only what has changed was read
    listed(2)
    listed(3)  # two listings in one run
    run()
    same(3)
    docs = changes.documents(spark, table).where("doc_id is not null")
    rebuilt = lexical.build_index(reader(spark, [])(spark.createDataFrame(list(states[3].items()), "path string, hash string")))
    followed = lexical.build_index(docs)
    for name in ("postings", "terms", "docs", "stats"):
        rows = lambda i: sorted(tuple(x) for x in getattr(i, name).collect())  # noqa: B023, E731
        assert rows(followed) == rows(rebuilt), name
    listed(4)
    run()
    run()  # nothing new
    same(4)
    listed(2)  # an old number says nothing
    run()
    same(4)
    for n in (5, 6):
        listed(n)
        run()
        same(n)


def test_changes_by_kind(spark, tmp_path):
    folder = str(tmp_path / "l")
    for n, rows in enumerate([[("a", "1"), ("b", "1"), ("b", "2")], [("a", "2"), ("c", "1")]]):
        changes.write_listing(spark.createDataFrame(rows, "path string, hash string"), n, folder, buckets=3)
    out: list[tuple] = []
    query = changes.changes(spark, folder).writeStream.foreachBatch(lambda b, _: out.extend(tuple(x)[1:] for x in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(out, key=str) == [(0, "insert", "a", "1"), (0, "insert", "b", "2"), (1, "delete", "b", None), (1, "insert", "c", "1"), (1, "update", "a", "2")]
