import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm.bagminhash import signatures
from lodestar.llm.components import components
from lodestar.llm.near_dup import near_duplicates, one_of_each

SCHEMA = "doc_id long, text string, v string, root int"


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(len(w) - 4, min(1, len(w)))))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """Class of each row: components of exact copies and of pairs with similarity 0.8 or more."""
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and jaccard(bags[i], bags[j]) >= 0.8:
                top[root(i)] = root(j)
    of = {t: root(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if d is not None:
            least[of[t or ""]] = min(least.get(of[t or ""], d), d)
    size = Counter(of[t or ""] for _, t in rows)
    return sorted(((d, least.get(of[t or ""]), size[of[t or ""]]) for d, t in rows), key=repr)


def families(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 40, 120, 300]))]
        rows.append(base)
        for _ in range(r.choice([0, 1, 2, 25])):
            w = list(r.choice(rows[-5:]) if r.random() < 0.3 else base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_classes_against_brute_force(spark, seed):
    rows = families(seed, 25)
    rows += [(9000, None), (9001, ""), (9002, " "), (9003, "a"), (9004, "a"), (9005, "a b"), (None, rows[3][1]), (None, "only null ids"), (7, rows[7][1]), (9100, "x " * 3000), (9101, "x " * 2900), (9102, "x " * 1000)]
    df = spark.createDataFrame([(d, t, "q", 1) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(df, block=16, members=7).collect()), key=repr)
    want = brute(rows)
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]] == []
    kept = one_of_each(df)
    assert kept.columns == df.columns
    out = Counter(r.doc_id for r in kept.collect())
    assert out == Counter({c: 1 for c in {c for _, c, _ in want if c is not None}} | {None: 1})


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    for top in (2, 5, 60, 1000):
        e = rng.integers(1, 2**63, 30).astype(np.uint64)
        a = rng.integers(0, top, 30)
        b = np.where(rng.random(30) < 0.5, a, rng.integers(0, top, 30))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        row = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        got = np.mean([(lambda s: (s[0] == s[1]).mean())(signatures(row, np.concatenate([e[a > 0], e[b > 0]]) + np.uint64(k * 977), np.concatenate([a[a > 0], b[b > 0]]), 2, 512)) for k in range(12)])
        assert abs(got - true) < 5 * (true * (1 - true) / 512 / 12) ** 0.5 + 1e-9


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(40)] + [(7, 7)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, got.values())) == [40, 51]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == one_of_each(df).count() == 0


def test_long_words_that_sums_of_powers_confuse(spark):
    """Words of 1,024 bytes in the Thue-Morse order and their complements: such texts share no shingle."""
    a, b = ("".join(x[i.bit_count() % 2] for i in range(1024)) for x in ("ab", "ba"))
    rows = [(1, " ".join([a] * 4 + ["x"])), (2, " ".join([b] * 4 + ["x"])), (3, " ".join([a] * 4 + ["x"]))]
    out = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in near_duplicates(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)).collect()}
    assert out == {1: (1, 2, 0), 2: (2, 1, 0), 3: (1, 2, 0)}


def test_links_are_counted(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:190] + [f"x{i}y{j}" for j in range(5)])) for i in range(6)] + [(9, "apart from all others")]
    out = {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in near_duplicates(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)).collect()}
    assert out.pop(9) == (9, 1, 0)
    assert {x[:2] for x in out.values()} == {(0, 6)} and all(x[2] >= 5 for x in out.values())


def test_of_repeated_rows_the_same_one_always_stays(spark):
    rows = [(1, "same text", v, k) for v in ("a", "b", "c") for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [tuple(one_of_each(x).first()) for x in (df, df.orderBy("v"), df.orderBy(F.desc("root")).repartition(3))]
    assert len(set(kept)) == 1 and kept[0] in rows
