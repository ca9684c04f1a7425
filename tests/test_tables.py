"""Table functions by SQL text."""

import random

from lodestar import models
from lodestar.functions import tables


def test_rerank_keeps_the_best_of_each_partition(spark):
    r = random.Random(4)
    words = ["ledger", "invoice", "credit", "tax"]
    rows = [(q, " ".join(words[: q + 1]), f"k{i:05d}", " ".join(r.choices([*words, "x"], k=r.randrange(4))) if i % 50 else None) for q in range(4) for i in range(3000 * (q == 1) + 40)]
    spark.createDataFrame(rows, "query_id int, query string, key string, passage string").repartition(5).createOrReplaceTempView("lodestar_hits")
    tables.register(spark)
    score = models.overlap_reranker()
    for k in (3, 200):
        want = []
        for q in range(4):
            best = sorted((-score(query, [p or ""])[0], key) for i, query, key, p in rows if i == q)[:k]
            want += [(str(q), key, -s, n) for n, (s, key) in enumerate(best, 1)]
        got = spark.sql(f"SELECT * FROM lodestar_rerank(t => TABLE(lodestar_hits) PARTITION BY query_id, k => {k})").collect()
        assert sorted(tuple(x) for x in got) == sorted(want)
    assert spark.sql("SELECT * FROM lodestar_rerank(TABLE(lodestar_hits) PARTITION BY query_id)").count() == 40
    assert spark.sql("SELECT * FROM lodestar_rerank(t => TABLE(SELECT * FROM lodestar_hits WHERE key = 'none') PARTITION BY query_id, k => 2)").collect() == []


def failing():
    def f(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("not this one")
        return [t.upper() for t in texts]

    return f


def test_own_models(spark):
    rows = [(1, "Two words, 2_x"), (2, None), (3, "bad text"), (4, "")]
    spark.createDataFrame(rows, "key int, text string").coalesce(1).createOrReplaceTempView("lodestar_texts")
    tables.register(spark, summariser=failing)
    got = lambda f: sorted((tuple(r) for r in spark.sql(f"SELECT * FROM {f}(TABLE(lodestar_texts))").collect()), key=str)
    assert got("lodestar_summarise") == [("1", "TWO WORDS, 2_X", None), ("2", "", None), ("3", None, "not this one"), ("4", "", None)]
    assert got("lodestar_tokens") == [("1", 0, "two"), ("1", 1, "words"), ("1", 2, "2_x"), ("3", 0, "bad"), ("3", 1, "text")]
    vectors = models.hashing_embedder()([t or "" for _, t in rows])
    assert [v for _, v in got("lodestar_embed")] == [v.tolist() for v in vectors]
    tables.register(spark)
