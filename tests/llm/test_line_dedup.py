import hashlib
import random

import pytest

from lodestar.llm.line_dedup import drop_common_lines, keep_bitmaps

STRIP = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs):
    seen = {}
    key = lambda x: x.strip(STRIP).translate(UPPER)
    for d, t in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(spark, rows, min_docs, **kw):
    df = spark.createDataFrame([(d, t, "x", 1, b"y") for d, t in rows], "doc_id long, text string, kept string, h1 int, raw binary")
    return sorted((tuple(r) for r in drop_common_lines(df, min_docs, **kw).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [f" Line {i}\t" for i in range(40)] + ["HOT", "hot ", "", "  ", "\x0bÉté\x0c", "éTÉ", "x\r"]
    rows = [(i if r.random() < 0.9 else i // 2, "\n".join(r.choice(pool) if r.random() < 0.7 else f"own {r.random()}" for _ in range(r.randint(1, 12)))) for i in range(300)]
    rows += [(None, "HOT\nhot"), (None, None), (5000, None), (5001, ""), (5002, "HOT"), (5002, "HOT"), (5003, "own\n" * 3000 + "hot")]
    assert got(spark, rows, 10) == brute(rows, 10)


def test_one_key_in_every_document_over_many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = [(i, "same line") for i in range(300)] + [(i, f"same line\nb{i // 10}\nc{i // 9}") for i in range(300, 500)]
        assert got(spark, rows, 10) == brute(rows, 10)
        assert got(spark, rows, 501) == brute(rows, 501)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_digest_and_empty_table(spark):
    assert got(spark, [(1, "a\nb")], 2, digest=True) == [(1, 2, 0, hashlib.sha256(b"a\nb").hexdigest())]
    assert got(spark, [], 2) == []
    assert keep_bitmaps(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 2).count() == 0
