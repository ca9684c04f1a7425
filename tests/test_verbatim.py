"""verbatim_items against its SQL, and the stand-in embedder, on texts that are easily got wrong."""

import duckdb
import numpy as np

from lodestar import models
from lodestar.llm.queries import ORACLES, QUERIES


def test_verbatim_items(spark, tmp_path):
    item = "one two three four five six"
    docs = ["two three four five six x one two three four five", f"so it says: {item}!", "ÉTÉ À ÇA VA OÙ", "", None, "...", "été à ça va", f"ONE, two (three) {item[14:]}"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "été à ça va où"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, contaminated FROM ({ORACLES['verbatim_items']})").fetchall())
    assert [x for x, y in want if y] == [1, 2, 7]
    assert sorted((r.doc_id, r.contaminated) for r in QUERIES["verbatim_items"](spark, str(tmp_path)).collect()) == want


def test_words_that_cancel_each_other_have_a_vector():
    embed, words = models.hashing_embedder(), [f"w{i}" for i in range(400)]
    alone = embed(words)
    a = next((x, y) for i, x in enumerate(words) for j, y in enumerate(words[:i]) if not (alone[i] + alone[j]).any())
    found = embed([" ".join(a), "", "w1"])
    assert np.allclose(np.linalg.norm(found, axis=1), [1, 0, 1]) and (found[2] == alone[1]).all()
