import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestar.llm.fill_in_middle import fill_in_middle, restored, unit_ends

SCHEMA = "doc_id long, text string, n int, output string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def run(spark, rows):
    out = fill_in_middle(spark.createDataFrame([(*r, 5, "z") for r in rows], SCHEMA))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return sorted((tuple(r) for r in out.withColumn("text", restored(F.col("output"), F.col("form"))).collect()), key=repr)


def test_against_brute_force(spark):
    r = random.Random(2)
    letters = "abcXYZ  .,\n\r\t0123éßñ漢字 😀👩‍👩‍👧́<>PSM\x00\x0b|"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(400)]
    texts += [None, "", "a", "é", "<P>", "x<S>y", "<M", "<", ">", "<<P", "P>", "S>M>", "ends with <", "<\n<", "a" * 70_000 + "é" * 70_000, "word. " * 40_000]
    rows = list(enumerate(texts)) + [(None, "null id stays"), (7, "same id"), (7, "same id"), (-5, "negative id\n")] + [(i, "one text") for i in range(1000, 1300)]
    want = sorted((brute(*x) for x in rows), key=repr)
    assert run(spark, rows) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_pieces_give_the_same_units():
    text = "abc, déf" * 50 + "Q" * 300 + "\n\n" + "é" * 99
    assert [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)] == unit_ends(text).tolist()
    for piece in (1, 2, 7, 64):
        assert unit_ends(text, piece).tolist() == unit_ends(text).tolist()


def test_empty_table(spark):
    assert run(spark, []) == []


def test_shares_of_the_forms(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text, cut anywhere").alias("text"))
    n = {r["form"]: r["count"] for r in fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(n["plain"] / 20_000 - 0.1) < 0.01 and abs(n["spm"] / (20_000 - n["plain"]) - 0.2) < 0.015
    n = {r["form"]: r["count"] for r in fill_in_middle(docs, plain_percent=0, spm_percent=100).groupBy("form").count().collect()}
    assert n == {"spm": 20_000}
