import random
import re
from collections import Counter

import numpy as np

from lodestar.llm.quality_rules import Limits, longest_repeats, quality_rules
from lodestar.llm.suffix import symbol_suffix_array, whole_common_prefixes

SCHEMA = "doc_id long, text string, n_words int, kept string"
WORD = r"[^\x20\x09-\x0D]+"


def windows(words, n):
    count = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return {p for i in range(len(words) - n + 1) if count[tuple(words[i : i + n])] > 1 for p in range(i, i + n)}


def brute(doc_id, text, limits):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    in8, in4 = windows(words, 8), windows(words, limits.least_words)
    longest = 0
    while longest < len(words) and windows(words, longest + 1):
        longest += 1
    chars, repeated = sum(map(len, words)), sum(len(words[p]) for p in in4)
    failed = len(words) < 20 or 100 * len(in8) > 30 * len(words)
    kept = not failed and 100 * repeated <= limits.covered_percent * chars and longest <= limits.longest_words
    return doc_id, len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(in8), failed, kept, repeated, longest


def run(spark, rows, limits):
    out = quality_rules(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), limits)
    order = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeated_chars", "longest_repeat"]
    return sorted((tuple(r) for r in out.select(order).collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    texts = []
    for n in [0, 1, 7, 19, 20, 21, 40, 200, 300]:
        for kinds in (2, 6, 40, 1000):
            words = [f"w{r.randrange(kinds)}é#"[: r.choice([3, 9])] for _ in range(n)]
            texts.append("".join(w + r.choice([" ", " ", "\n", "\t", "\r\n", "\n\n"]) for w in words))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " x " + passage, " ".join(f"u{i}" for i in range(300)) + " " + passage + "\n" + passage, "As " * 300, "a b " * 50, " ".join(f"v{i}" for i in range(90)) + " lol" * 7]
    texts += [None, "", " \t\n\x0b", "\n\n", "same line here\nsame line here\n other\nsame line here", "   ", "漢字 " * 30, "x" * 200_000 + " y"]
    rows = list(enumerate(texts)) + [(None, passage), (3, texts[20]), (3, texts[20])]
    for limits in (Limits(), Limits(least_words=3, covered_percent=15, longest_words=39)):
        want = sorted((brute(*x, limits) for x in rows), key=str)
        assert run(spark, rows, limits) == want
        assert {w[7] for w in want} == {True, False}
        assert any(not w[6] and not w[7] for w in want)  # the method's own verdict counts


def test_empty_table(spark):
    assert run(spark, [], Limits()) == []


def test_longest_repeats_of_any_string():
    r = random.Random(1)
    for _ in range(300):
        s = np.array([r.randrange(r.choice([1, 2, 5, 60])) for _ in range(r.randrange(1, 70))])
        if r.random() < 0.3:
            s = np.tile(s, 3)
        x = s.tolist()
        common = lambda i, j: next((k for k in range(len(x)) if max(i, j) + k >= len(x) or x[i + k] != x[j + k]), len(x))  # noqa: B023, E731
        assert longest_repeats(s).tolist() == [max((common(i, j) for j in range(len(x)) if j != i), default=0) for i in range(len(x))]


def test_whole_common_prefixes_of_long_repeats():
    r = np.random.default_rng(2)
    part = r.integers(1, 50_000, 20_000)
    s = np.append(np.unique(np.concatenate([part, [60_000], part, [60_001], part]), return_inverse=True)[1] + 1, 0)
    order = symbol_suffix_array(s)
    got = whole_common_prefixes(s, order)
    assert got.max() == 20_000
    for a, b in zip(order[:-1:997], order[1::997]):
        n = min(len(s) - a, len(s) - b)
        differ = np.flatnonzero(s[a : a + n] != s[b : b + n])
        assert got[b] == (differ[0] if len(differ) else n)
