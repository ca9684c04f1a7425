"""Fuzzy matches, completions and facets against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.operators import suggest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(r, s):
    s = list(s)
    for _ in range(r.randrange(0, 4)):
        i = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(i, r.choice("abxü"))
        elif s:
            i = min(i, len(s) - 1)
            s[i : i + 1] = [] if kind == 1 else [r.choice("abxü")]
    return "".join(s)


def test_fuzzy_matches(spark):
    r = random.Random(6)
    names = ["".join(r.choices("abcü_", k=r.randrange(0, 18))) for _ in range(120)] + ["aaaaaaaaaa", "aaaaaaaaaaa", "CUSTOMER_ORDER_API", "CUSTOMER_ODER_API", "", "a", "b", "ab", "aB", None]
    queries = [changed(r, n or "") for n in names for _ in range(2)] + names
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    plain = lambda x: {n for n in x if n is not None}
    for threshold in (70, 80, 85, 100):
        want = {}
        for a in plain(queries):
            for b in plain(names):
                m, dist = max(len(a), len(b)), distance(a, b)
                if 100 * (m - dist) >= threshold * m:
                    want[a, b] = dist
        got = suggest.fuzzy_matches(frame(queries), frame(names), threshold).collect()
        assert {(x["query"], x["name"]): x["distance"] for x in got} == want and len(got) == len(want)
        assert all(threshold <= x["ratio"] <= 100 for x in got)
    assert suggest.fuzzy_matches(frame([]), frame(names)).collect() == []
    with pytest.raises(ValueError, match="thresholds"):
        suggest.fuzzy_matches(frame(names), frame(names), 60)


def test_names_that_share_their_pairs_of_letters(spark):
    """Names one edit of each other meet by their letters but one: names with the same frequent pairs do not meet."""
    names = [f"OrderLineX{n:04d}.plsql".translate(str.maketrans("0123456789", "abcdefghij")) for n in range(0, 3000, 7)] + ["OrderLineXabcde.plsql", "OrderLineXabce.plsql"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(a, b) for a in names for b in names if abs(len(a) - len(b)) <= 1 and sum(x != y for x, y in zip(a, b, strict=False)) <= 12 and distance(a, b) <= 1}
    assert {(r["query"], r["name"]) for r in suggest.fuzzy_matches(frame, frame, 92).collect()} == want
    keys = suggest._keyed(frame.select(F.col("name").alias("n"), F.array(F.lit(0)).alias("sides"), F.length("name").alias("length")), 92)
    meet = Counter((r["longer"], r["key"]) for r in keys.collect())
    assert sum(n * (n - 1) for n in meet.values()) < 4 * len(want)


def test_completions(spark):
    r = random.Random(7)
    rows = [("".join(r.choices("abC", k=r.randrange(1, 6))), r.randrange(4)) for _ in range(400)] + [("", 9), (None, 9), ("Solo", None)]
    table = suggest.completions(spark.createDataFrame(rows, "name string, weight long").repartition(5), 3, longest=4)
    total = Counter()
    for n, w in rows:
        if n:
            total[n] += w or 0
    want = []
    for prefix in {n.lower()[:i] for n in total for i in range(1, 5)}:
        best = sorted((n == "Solo", -w, n) for n, w in total.items() if n.lower().startswith(prefix))[:3]
        want += [(prefix, i, n, None if n == "Solo" else -w) for i, (_, w, n) in enumerate(best, 1)]
    assert sorted((tuple(x) for x in table.collect()), key=str) == sorted(want, key=str)
    first = [x.name for x in suggest.complete(table, "A").collect()]
    assert first == [n for p, _, n, _ in sorted(w for w in want if w[0] == "a")] and suggest.complete(table, "zz").collect() == []
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan  # tasks keep k names of a prefix before the exchange


def test_facets(spark):
    r = random.Random(8)
    rows = [(r.choice(["en", "de", None]), r.choice("xyz"), r.randrange(3)) for _ in range(500)]
    hits = spark.createDataFrame(rows, "lang string, module string, n int")
    values = {"lang": F.col("lang"), "module": F.col("module"), "n": F.col("n")}
    chosen = {"lang": F.col("lang") == "en", "module": F.col("module").isin("x", "y")}
    passes = [lambda x: x[0] == "en", lambda x: x[1] in "xy", lambda x: True]
    want = Counter()
    for x in rows:
        for i, f in enumerate(values):
            if all(p(x) for j, p in enumerate(passes) if j != i):
                want[f, None if x[i] is None else str(x[i])] += 1
    got = suggest.facets(hits, chosen, values).collect()
    assert {(x["facet"], x["value"]): x["n"] for x in got} == dict(want) and len(got) == len(want)
    assert suggest.facets(hits.limit(0), chosen, values).collect() == []
    assert {(x["facet"], x["value"]): x["n"] for x in suggest.facets(hits, {}, {"module": F.col("module")}).collect()} == {("module", m): n for m, n in Counter(x[1] for x in rows).items()}
