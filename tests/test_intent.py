"""The trained types of queries on held-out and on odd queries."""

import random

from pyspark.sql import functions as F

from lodestar.operators import intent, query


def forms(r, n):
    words = ["ledger", "invoice", "credit", "tax", "order", "stock", "customer", "shipment"]
    out = []
    for _ in range(n):
        a, b = r.sample(words, 2)
        out += [(f"{a}_{b}_API".upper(), "exact_match"), (f"select {a} from {b}_tab", "code_pattern"), (f"procedure {a}_{b} in", "code_pattern"), (f"why is the {a} of a {b} refused", "semantic"), (f"explain when {a} needs {b}", "semantic"), (f"{a} {b}", "mixed"), (f"{a} {b} list", "mixed")]
    return out


def test_held_out_queries(spark):
    frame = lambda seed, n: spark.createDataFrame(forms(random.Random(seed), n), "query string, type string")
    model = intent.train(frame(1, 60))
    found = intent.classify(model, frame(2, 60), "learned").withColumn("ruled", query.query_type(F.col("query"))).collect()
    learned = sum(x.learned == x.type for x in found) / len(found)
    ruled = sum(x.ruled == x.type for x in found) / len(found)
    assert learned >= 0.97 and learned > ruled + 0.1, (learned, ruled)
    assert all(0.25 <= x.likelihood <= 1 for x in found)
    odd = intent.classify(model, spark.createDataFrame([(None, 1), ("", 2), ("漢字", 3), ("word " * 5000, 4)], "query string, type int"), "learned")
    assert odd.columns == ["query", "type", "learned", "likelihood"] and odd.where("learned is not null").count() == 4
