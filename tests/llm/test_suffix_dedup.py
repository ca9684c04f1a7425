import hashlib
import random

import numpy as np
import pytest

from lodestar.llm.suffix import common_prefixes, suffix_array
from lodestar.llm.suffix_dedup import drop_repeated_strings, least_documents

SCHEMA = "doc_id long, text string, kept string, d int, chunk int"


def strings(seed):
    r = np.random.default_rng(seed)
    for _ in range(60):
        s = r.integers(1, 1 + r.integers(1, 6), int(r.integers(1, 120)))
        yield np.append(s, 0)
        yield np.append(np.tile(s[:5], 20), 0)


def test_suffix_array_and_prefixes():
    for s in strings(1):
        order = suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        for most in (3, 50):
            got = common_prefixes(s, order, most)
            for k in range(1, len(s)):
                a, b = s[order[k - 1] :].tolist(), s[order[k] :].tolist()
                same = 0
                while same < min(len(a), len(b)) and a[same] == b[same]:
                    same += 1
                assert got[k] == min(same, most)


def test_least_documents_of_rival_segments():
    def segment(text, doc):
        return (np.uint64(7), doc, len(text) - 3, text)

    rows = [segment(b"abcdef", 5), segment(b"bcdefg", 3), segment(b"abcdef", 4), segment(b"zzzz", 9), segment(b"xabcd", 8)]
    out = least_documents(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), np.uint8), 4)
    # windows: abcd bcde cdef | bcde cdef defg | abcd bcde cdef | zzzz | xabc abcd
    assert out.tolist() == [4, 3, 3, 3, 3, 3, 4, 3, 3, 9, 8, 4]


def brute(rows, width):
    least = {}
    key = lambda d: -(2**62) if d is None else d
    raws = [(t or "").encode() for _, t in rows]
    for (d, _), raw in zip(rows, raws, strict=True):
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            least[w] = min(least.get(w, 2**62), key(d))
    out = []
    for (d, _), raw in zip(rows, raws, strict=True):
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            if least[raw[i : i + width]] < key(d):
                gone[i : i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(spark, rows, width, **kw):
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)
    return sorted(((r[0], r[1], r[2], r[3], r[4] if isinstance(r[4], str) else bytes(r[4])) for r in drop_repeated_strings(df, width, **kw).collect()), key=repr)


@pytest.mark.parametrize(("seed", "width"), [(0, 50), (1, 50), (2, 24), (3, 8)])
def test_against_brute_force(spark, seed, width):
    r = random.Random(seed)
    letters = "ab é\n" if seed != 1 else "abcdefghijklmnop qrstuvwxyz éß\n"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [text(r.randint(width // 2, 4 * width)) for _ in range(8)]
    rows = []
    for d in range(120):
        t = text(r.randint(0, 150))
        if r.random() < 0.7:
            p = r.choice(passages)
            if r.random() < 0.6:
                k = r.randrange(len(p))
                p = p[:k] + "X" + p[k + 1 :]
            at = r.randrange(len(t) + 1)
            t = t[:at] + p + t[at:]
        rows.append((d, t))
    rows += [(300, "a" * 400), (301, "a" * 300), (302, None), (302, ""), (None, rows[9][1]), (303, "ab" * 200), (304, "x" * (width - 1)), (305, "x" * (width - 1))]
    rows += [(400 + i, passages[0] * 2) for i in range(40)] + [(2, rows[2][1]), (3, rows[4][1] + passages[1])]
    r.shuffle(rows)
    assert got(spark, rows, width, chunk_bytes=3000) == brute(rows, width)


def test_digest_and_empty(spark):
    assert got(spark, [(1, "ab")], 50, digest=True) == [(1, 2, 0, 0, hashlib.sha256(b"ab").hexdigest())]
    assert got(spark, [], 50) == []


def test_a_hot_phrase_spreads_over_shards(spark):
    """A phrase of 28 bytes in every third text, with other text around it: its segments share a representative and
    nothing else. Some texts repeat whole windows around it, which must still meet."""
    import pyspark.sql.functions as F

    from lodestar.llm.exchange import asked, chunked, merged
    from lodestar.llm.suffix_dedup import Steps, answer_keys, pack_answers

    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz "
    some = lambda n: "".join(r.choices(letters, k=n))
    phrase = "permission is granted hereby"
    rows = [(i, some(30) + phrase + some(40) if i % 3 == 0 else some(98)) for i in range(50_000)]
    for i in range(1, 40):  # the phrase with some of its surroundings, elsewhere
        rows[3 * i] = (3 * i, rows[30_000 + 3 * i][1][10:80])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted(tuple(x) for x in drop_repeated_strings(docs, 50, chunk_bytes=256 << 10, most_segments=256).collect())
    assert [(*x[:4], bytes(x[4])) for x in got] == sorted(brute(rows, 50))
    assert sum(x[2] for x in got) > 39 * 50

    def largest(most):
        chunks, n = chunked(docs, 256 << 10)
        steps = Steps(50, n)
        first = merged(asked(chunks, steps.keys), answer_keys(most), n, pack_answers)
        sizes = asked(chunks, steps.segments, first).where("step = 2").groupBy("shard").agg(F.sum(F.length("payload")).alias("b")).collect()
        return max(x.b for x in sizes), sorted([x.b for x in sizes] + [0] * (n - len(sizes)))[n // 2]

    most, median = largest(256)
    assert most <= 3 * median
    most, median = largest(1 << 40)
    assert most > 3 * median  # so it was
