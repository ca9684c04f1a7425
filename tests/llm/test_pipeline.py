import random

from pyspark.sql import types as T

import corpus_pipeline
from lodestar.llm.quality import score_documents, train

from .test_bpe import expected
from .test_decontaminate import brute as brute_decontaminated
from .test_line_dedup import brute as brute_lines
from .test_near_dup import brute as brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(i, sentence(25)) for i in range(10)]
    docs, labels = [], []
    for d in range(260):
        good = r.random() < 0.8
        body = [sentence(r.randint(10, 40)) for _ in range(r.randint(1, 4))]
        if not good:
            body = [x.upper().replace(" ", "!! ") + "###" for x in body]
        if r.random() < 0.3:
            body.insert(0, "Licensed to ALL ")
        if r.random() < 0.1:
            body.append("so " + r.choice(items)[1] + " it")
        if docs and r.random() < 0.2:
            body = r.choice(docs)[1].split("\n")
            if r.random() < 0.5:
                body = [*body, "tail"]
        docs.append((d, "\n".join(body)))
        labels.append((d, int(good)))
    return docs + [(900, ""), (901, None)], labels, items


def test_run_against_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    marks.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in score_documents(frame, train(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect() if r.predicted}
    kept = [(d, t) for d, t in docs if d in good]
    assert 100 < len(kept) < len(docs)
    text = {d: (t if dict(kept)[d] is not None else None) for d, _, _, t in brute_lines(kept, 10)}
    rows = [(d, text[d]) for d, _ in kept]
    rows = [(d, text[d]) for d, c, _ in brute_classes(rows) if d == c]
    clean = {d for d, found in brute_decontaminated(rows, [(i, t, None) for i, t in items]) if not found}
    want = expected([(d, t) for d, t in rows if d in clean])
    assert 20 < len(want) < len(rows) < len(kept)
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
    assert docs.count() == 0


def test_stages_leave_columns_with_clashing_names_alone(spark, tmp_path):
    names = ["_raw", "_items", "_overlaps", "_d", "_rk", "_md", "_mrk", "_keep", "_v", "_nd", "_nv", "raw", "v", "d", "sig", "key", "band", "root", "h", "y"]
    rows = [(i, f"some text number {i} with words enough to be kept", None, *[f"{n}{i}" for n in names]) for i in range(12)]
    rows += [(None, None, None, *[None] * len(names)), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quite other words than those in the texts")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "n_chars", *names]
    out = docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [*[(False, i) for i in range(12)], (True, 0)]
    assert all(r[n] == (f"{n}{r.doc_id}" if r.doc_id is not None else None) for r in out for n in names)
