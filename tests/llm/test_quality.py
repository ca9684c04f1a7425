import random
import zlib

import numpy as np

from lodestar.llm.quality import STATS, Machine, accepted, features, fit, score_documents, train

SCHEMA = "doc_id long, text string, score string, source string"


def text(r, good):
    words = ["".join(r.choice("aeioubcdst") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 80))]
    if not good:
        kind = r.randrange(3)
        words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1 else [w for w in words[:8] for _ in range(9)]
    return " ".join(words)


def corpus(seed, n):
    r = random.Random(seed)
    rows = [(i, r.random() < 0.8) for i in range(n)]
    return [(i, text(r, g)) for i, g in rows], [(i, int(g)) for i, g in rows]


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    dims = 64
    m = Machine(dims, np.sort(rng.normal(size=(STATS, 3)), 1), 0.3, rng.normal(size=dims + STATS * 4), rng.normal(size=(dims + STATS * 4, 5)))
    body = np.frombuffer("aa bb aa cc\nDD 12 aa é!".encode(), np.uint8)
    offsets = np.array([0, 11, len(body)])
    at, slot, value = m.rows(*features(body, offsets, dims))
    got, _ = m.margins(at, slot, value, 2)
    for row in range(2):
        s, x = slot[at == row], value[at == row]
        pairs = sum(m.factors[s[i]] @ m.factors[s[j]] * x[i] * x[j] for i in range(len(s)) for j in range(i + 1, len(s)))
        assert np.isclose(got[row], m.bias + m.linear[s] @ x + pairs)


def test_held_out_accuracy(spark):
    rows, labels = corpus(4, 1500)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows] + [(None, None, None, None), (9000, "", "", ""), (9001, "wort " * 100_000, "", "")], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    model = train(docs, marks, train_rows=600, dims=1 << 12)
    out = {r.doc_id: r for r in score_documents(docs, model).collect()}
    assert len(out) == 1503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    kept = accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    assert [r.score for r in score_documents(docs, train(docs, none)).collect()] == [0.5]
    empty = spark.createDataFrame([], SCHEMA)
    assert score_documents(empty, fit([], 64)).count() == accepted(empty, fit([], 64)).count() == 0


def test_repeated_rows_score_alike_and_count_once_in_training(spark):
    rows, labels = corpus(6, 300)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = train(docs, marks.union(marks), dims=1 << 10)
    twice = docs.union(docs)
    out = {}
    for r in score_documents(twice, model).collect():
        out.setdefault(r.doc_id, []).append(r.score)
    assert all(len(s) == 2 and s[0] == s[1] for s in out.values()) and len(out) == 300
    kept = accepted(twice, model).groupBy("doc_id").count()
    assert kept.where("count <> 2").isEmpty()
