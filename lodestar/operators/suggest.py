"""EXTENSIONS, which the system this follows only announces: fuzzy matches of names, completions, facets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM = 2


def _grams(name: Column) -> Column:
    """The name's overlapping pairs of letters, each with how often it has come before: a set in place of a multiset."""
    plain = F.transform(F.sequence(F.lit(1), F.length(name) - GRAM + 1), lambda i: F.substring(name, i, F.lit(GRAM)))
    numbered = F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, F.lit(1), i), lambda x: x == g)).cast("string")))
    return F.when(F.length(name) >= GRAM, numbered).otherwise(F.array().cast("array<string>"))


def _keyed(rows: DataFrame, threshold: int) -> DataFrame:
    """(n, sides, length, longer, key) of names (n, sides, length): by which each meets those within the threshold whose
    longer name has the length `longer`, its equals apart."""
    lengths = rows.select(F.col("length").alias("longer")).distinct()  # a handful
    edits = F.floor(F.col("longer") * (100 - threshold) / 100)
    near = (F.col("length") <= F.col("longer")) & (F.col("length") * 100 >= F.col("longer") * threshold)
    paired = rows.join(F.broadcast(lengths.withColumn("edits", edits).where("edits > 0")), near)
    # one edit: a name of the longer length without each letter, a name that is one letter shorter as it is
    without = F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.concat(F.substring("n", F.lit(1), i - 1), F.substring("n", i + 1, F.col("length"))))
    cut = F.when(F.col("length") == F.col("longer"), F.array_distinct(without)).when(F.col("length") == F.col("longer") - 1, F.array("n"))
    keyed = paired.where("edits = 1").select("n", "sides", "length", "longer", F.explode(cut).alias("key"))
    # more edits: the rarest pairs of letters
    share = 100 - GRAM * (100 - threshold)
    least = F.ceil((F.col("longer") * share - 100 * (GRAM - 1)) / 100)  # pairs that a match of a name of this length shares
    several = paired.where("edits > 1").withColumn("least", least)  # one at least, from a threshold of 60 on
    grams = several.select("n").distinct().select("n", F.explode(_grams(F.col("n"))).alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = grams.join(rarity, "gram").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    first = F.slice("g", F.lit(1), F.greatest(F.size("g") - F.col("least") + 1, F.lit(0)).cast("int"))
    by_grams = several.join(ordered, "n").select("n", "sides", "length", "longer", F.explode(F.transform(first, lambda x: x["gram"])).alias("key"))
    return keyed.unionByName(by_grams)


def fuzzy_matches(queries: DataFrame, names: DataFrame, threshold: int = 80, name: str = "name") -> DataFrame:
    """(query, name, distance, ratio) of all pairs whose ratio, 100 * (1 - edit distance / the longer length), reaches
    the threshold (70 to 100): a set-similarity join, verified. Nulls match nothing; equal names of a side are one.

    The longer of two names tells how many edits the ratio allows them, so names meet by keys that they have for each
    length of a longer name that is there. Where one edit is allowed, the keys are a name without each of its letters in
    turn, or as it is if it is the shorter one: those are nearly as few as the matches. Where more are, names share a
    number of pairs of letters that follows from the length, so that they share one of the first few if each name's are
    put in one order, the rarest first. What meets is measured. Equal names match as such."""
    if not 70 <= threshold <= 100:
        raise ValueError("thresholds below 70 do not bound what names share")
    one = lambda df, side: df.select(F.col(name).alias("n")).where(F.col("n").isNotNull()).distinct().withColumn("side", F.lit(side))
    rows = one(queries, 0).unionByName(one(names, 1)).groupBy("n").agg(F.collect_set("side").alias("sides")).withColumn("length", F.length("n"))
    keyed = _keyed(rows, threshold)
    side = lambda s, prefix: keyed.where(F.array_contains("sides", s)).select(F.col("n").alias(prefix), F.col("length").alias(f"{prefix}_length"), "longer", "key")
    met = side(0, "query").join(side(1, "name"), ["longer", "key"]).where((F.greatest("query_length", "name_length") == F.col("longer")) & (F.col("query") != F.col("name"))).select("query", "name", "longer").distinct()
    measured = met.withColumn("distance", F.levenshtein("query", "name")).where(100 * (F.col("longer") - F.col("distance")) >= threshold * F.col("longer"))
    equal = rows.where(F.size("sides") == 2).select(F.col("n").alias("query"), F.col("n").alias("name"), F.lit(0).alias("distance"), F.lit(100.0).alias("ratio"))
    return measured.select("query", "name", "distance", (100.0 * (F.col("longer") - F.col("distance")) / F.col("longer")).alias("ratio")).unionByName(equal)


def completions(names: DataFrame, k: int = 5, longest: int | None = None, name: str = "name", weight: str = "weight") -> DataFrame:
    """(prefix, place, name, weight): the k heaviest names that begin with each prefix, without regard to case, ties by
    name; equal names add up. longest: prefixes up to so many characters, or of any length. Every task keeps k names of
    a prefix before anything is exchanged, so a prefix of all names costs k rows a task."""
    total = names.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(name).alias("name")).agg(F.sum(weight).alias("weight"))
    upto = F.length("name") if longest is None else F.least(F.length("name"), F.lit(longest))
    each = total.select(F.explode(F.transform(F.sequence(F.lit(1), upto), lambda i: F.substring(F.lower("name"), F.lit(1), i))).alias("prefix"), "name", "weight")
    order = Window.partitionBy("prefix").orderBy(F.desc_nulls_last("weight"), "name")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("prefix", "place", "name", "weight")


def complete(table: DataFrame, typed: str) -> DataFrame:
    """The completions of what has been typed, in order; table: completions(), as it was or written and read."""
    return table.where(F.col("prefix") == typed.lower()).orderBy("place").select("name", "weight")


def facets(hits: DataFrame, chosen: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """(facet, value, n): for each facet how many hits each of its values has under the filters of all other facets.

    values: a facet's value of a row; chosen: a facet's filter, which counts as passed where there is none and as failed
    where it is null. A hit that fails no filter counts for every facet, one that fails one for that filter's facet
    alone, and others for none. All is one aggregation by grouping sets; a task sends a row a value."""
    passes = {f: F.coalesce(chosen[f], F.lit(False)) if f in chosen else F.lit(True) for f in values}
    rows = hits.select(*[v.cast("string").alias(f"v_{f}") for f, v in values.items()], *[p.alias(f"p_{f}") for f, p in passes.items()])
    failed = lambda others: reduce(lambda a, b: a + b, [(~F.col(f"p_{f}")).cast("int") for f in others], F.lit(0))
    rows = rows.withColumn("failed", failed(values)).where("failed <= 1")
    columns = [F.col(f"v_{f}") for f in values]
    counts = [F.count_if((F.col("failed") == 0) | ~F.col(f"p_{f}")).alias(f"n_{f}") for f in values]
    sets = rows.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id(*columns).alias("set"), *counts)
    n = len(values)
    of = lambda i: F.col("set") == (2**n - 1) ^ (1 << (n - 1 - i))  # noqa: E731  the set that keeps column i
    pick: Callable[[list[Column]], Column] = lambda parts: F.coalesce(*[F.when(of(i), p) for i, p in enumerate(parts)])
    found = sets.select(pick([F.lit(f) for f in values]).alias("facet"), pick(columns).alias("value"), pick([F.col(f"n_{f}") for f in values]).alias("n"))
    return found.where("n > 0")
