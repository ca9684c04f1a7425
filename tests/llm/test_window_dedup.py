import hashlib
import random
import re

import pytest

from lodestar.llm.window_dedup import drop_repeated_windows

SCHEMA = "doc_id long, text string, kept string, chunk int, d long"


def brute(rows, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = {}
    for w in split:
        for i in range(len(w) - width + 1):
            count[tuple(w[i : i + width])] = count.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def got(spark, rows, width, **kw):
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in drop_repeated_windows(df, width, **kw).collect()), key=repr)


@pytest.mark.parametrize(("seed", "width"), [(0, 35), (1, 12), (2, 3)])
def test_against_brute_force(spark, seed, width):
    r = random.Random(seed)
    vocab = ["é", "ab", "c", "ß\x85x", "long-word", " "] + [f"w{i}" for i in range(60)]
    passage = [[r.choice(vocab) for _ in range(r.randint(width, 3 * width))] for _ in range(8)]
    rows = []
    for d in range(200):
        w = [r.choice(vocab) for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            p = list(r.choice(passage))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "mut"
            at = r.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((d, r.choice([" ", "\n", "\t "]).join(w)))
    rows += [(300, "same " * 500), (301, "a b " * width), (302, " ".join(map(str, range(2 * width)))), (303, None), (303, ""), (None, rows[5][1]), (304, " \n\t")]
    rows += [(400 + i, " ".join(passage[0])) for i in range(60)] + [(999, rows[7][1]), (7, rows[7][1])]
    assert got(spark, rows, width, chunk_bytes=4000) == brute(rows, width)


def test_long_words_that_sums_of_powers_confuse(spark):
    """Words of 1,024 bytes in the Thue-Morse order and their complements: equal under any sum of powers modulo 2 ** 64."""
    a, b = ("".join(x[i.bit_count() % 2] for i in range(1024)) for x in ("ab", "ba"))
    words = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join([*words, a, *words])), (2, " ".join([*words, b, *words]))]
    assert got(spark, rows, 35) == brute(rows, 35) and brute(rows, 35)[0][2] == 0


def test_digest_and_empty(spark):
    assert got(spark, [(1, "a  b")], 35, digest=True) == [(1, 2, 0, hashlib.sha256(b"a b").hexdigest())]
    assert got(spark, [], 35) == []


def test_steps_do_not_depend_on_the_order_of_rows():
    import numpy as np
    import pyarrow as pa

    from lodestar.llm import exchange, suffix_dedup, window_dedup

    rows = [(i, " ".join(f"w{(i % 7) * 50 + j}" for j in range(60 + i))) for i in range(40)]
    table = lambda rs: pa.table([pa.array([r[0] for r in rs], pa.int64())] * 2 + [pa.array([r[1].encode() for r in rs])], ["doc_id", "d", "raw"])
    shuffled = rows[::-1]

    def answers(sent, f, pack=exchange.packed_bits):
        own = sent["step"].to_numpy() == exchange.OWN
        t = sent.filter(pa.array(~own))
        bits = f([x.as_py() for x in t["payload"]])
        out = t.set_column(3, "payload", pa.array([pack(b) for b in bits], pa.binary()))
        return pa.concat_tables([out, sent.filter(pa.array(own))])

    for steps, ask, find, grouped in ((window_dedup.Steps(35, 3, 1 << 16), "sketch", "exact", window_dedup._exactly_repeated), (suffix_dedup.Steps(50, 3), "keys", "segments", suffix_dedup._shard(50))):
        first = answers(getattr(steps, ask)(0, table(rows), None), *((suffix_dedup.answer_keys(4096), suffix_dedup.pack_answers) if ask == "keys" else (steps.count_min.add_up,)))
        second = answers(getattr(steps, find)(0, table(shuffled), first), grouped)
        a, b = (steps.result(table(r), second, False).sort_by("doc_id") for r in (rows, shuffled))
        assert a.equals(b) and sum(a.column(2).to_pylist()) > 0
