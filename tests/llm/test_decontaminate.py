import random
import string

import numpy as np
import pytest

from lodestar.llm.decontaminate import Index, contamination, terms, uncontaminated

SCHEMA = "doc_id long, text string, items int, _x string"


def words(text):
    out = []
    for w in text.split():
        w = "".join(c.lower() if c in string.ascii_uppercase else c for c in w.strip(string.punctuation))
        if w:
            out.append(w)
    return out


def grams(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(docs, items, overlap=0.8):
    parts = [(i, [words(t) for t in (q, a) if t and words(t)]) for i, q, a in items]
    parts = [(i, p) for i, p in parts if p]
    span = max([5, *(sum(map(len, p)) for _, p in parts)])
    out = []
    for d, t in docs:
        ws, found = words(t or ""), set()
        for s in range(0, max(1, len(ws)), span):
            window = ws[s : s + 2 * span]
            for i, p in parts:
                if all(len(grams(x, min(5, len(x))) & grams(window, min(5, len(x)))) / len(grams(x, min(5, len(x)))) >= overlap - 1e-9 for x in p):
                    found.add(i)
        out.append((d, sorted(found)))
    return sorted(out, key=repr)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(120)]
    text = lambda k: " ".join(r.choice(vocab) + r.choice(["", "", ",", ".", "\n"]) for _ in range(k))
    items = [(i, text(r.randint(1, 30)), text(r.randint(1, 8)) if i % 3 == 0 else None) for i in range(40)]
    docs = []
    for d in range(n):
        body = text(r.randint(0, 150)).split(" ")
        for _ in range(r.randint(0, 2)):
            _, q, a = r.choice(items)
            leak = (q + " " + (a or "")).split(" ")
            for _ in range(r.randint(0, 6)):
                leak[r.randrange(len(leak))] = r.choice(vocab)
            at = r.randrange(len(body) + 1)
            body[at:at] = [w.upper() if r.random() < 0.1 else w for w in leak]
        docs.append((d, " ".join(body)))
    return docs, items


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    docs, items = corpus(seed)
    docs += [(None, items[0][1] + " " + (items[0][2] or "")), (500, None), (501, ""), (502, "-- !"), (3, docs[3][1]), (503, "long text " * 30_000 + items[7][1])]
    items += [(None, "", ""), (900, None, None), (7, items[7][1], items[7][2])]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA)
    marks = spark.createDataFrame(items, "item_id long, text string, answer string")
    want = brute(docs, items)
    assert sum(bool(x) for _, x in want) > 5
    for size in (16 << 20, 600):
        out = contamination(frame, marks, index_bytes=size).collect()
        got = sorted(((r.doc_id, r["items"]) for r in out), key=repr)
        assert [g for g, w in zip(got, want, strict=True) if g != w] == []
        assert all(r.contaminated == (r.n_items > 0) == (r.overlap >= 0.8) for r in out)
    kept = uncontaminated(frame, marks, index_bytes=600)
    assert kept.columns == frame.columns and kept.count() == sum(not x for _, x in want)
    kept = uncontaminated(frame, marks)
    assert kept.columns == frame.columns and kept.count() == sum(not x for _, x in want)


def test_blocks_are_skipped_but_none_is_lost():
    docs, items = corpus(9, 30)
    index = Index([(i, q, a) for i, q, a in items], block_items=4)
    body = " ".join(t for _, t in docs).encode()
    h, row = terms(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    assert len(set(index.search(h, row))) < len(items) * (len(h) // index.span + 1) / 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, "")], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in contamination(docs, none).collect()] == [False]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_search_gives_what_exhaustive_scoring_gives():
    docs, items = corpus(11, 40)
    index = Index([(i, q, a) for i, q, a in items], block_items=3)
    texts = [t.encode() for _, t in docs]
    h, row = terms(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    want = set()
    for r in range(len(texts)):
        own = h[row == r]
        for p in range(-(-len(own) // index.span)):
            asked = set(own[p * index.span : (p + 2) * index.span].tolist())
            score = np.zeros(index.n)
            for k, v in enumerate(index.vocabulary.tolist()):
                if v in asked:
                    score[index.item[index.first[k] : index.first[k + 1]]] += index.score[index.first[k] : index.first[k + 1]]
            want |= {(r, p, i) for i in np.flatnonzero(score >= index.least[:-1] - 1e-9).tolist()}
    assert set(index.search(h, row, together=50)) == want and len(want) > 10


def test_long_words_that_sums_of_powers_confuse(spark):
    a, b = ("".join(x[i.bit_count() % 2] for i in range(1024)) for x in ("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{a} {a} {b} one", 0, ""), (2, f"{b} {b} {a} one", 0, "")], SCHEMA)
    items = spark.createDataFrame([(5, f"{a} {a} {b} one")], "item_id long, text string")
    assert sorted((r.doc_id, r["items"]) for r in contamination(docs, items).collect()) == [(1, [5]), (2, [])]


def test_a_hundred_shards_one_index_at_a_time(spark, monkeypatch):
    """Shards as many as a large benchmark has; a pass each, whose broadcast has gone before the next one comes."""
    from pyspark import SparkContext

    from lodestar.llm import decontaminate

    docs, items = corpus(4, 60)
    alive, most, sizes = set(), [], []
    make = SparkContext.broadcast

    def broadcast(self, value):
        b = make(self, value)
        alive.add(id(b))
        most.append(len(alive))
        sizes.append(value.n)
        gone = b.destroy
        b.destroy = lambda *a: (alive.discard(id(b)), gone(*a))
        return b

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    marks = spark.createDataFrame(items, "item_id long, text string, answer string").coalesce(1)
    size = sum(len((q or "").encode()) + len((a or "").encode()) for _, q, a in items)
    got = sorted(((r.doc_id, r["items"]) for r in decontaminate.contamination(frame, marks, index_bytes=size // 99).collect()), key=repr)
    assert got == brute(docs, items) and sum(bool(x) for _, x in got) > 5
    assert len(sizes) >= 99 and max(most) == 1 and max(sizes) < len(items) / 4
