"""Joins whose larger side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than this part of all rows are hot. There are fewer than PARTS of them, whatever the input.
PARTS = 400
#: Items that the sketch behind approx_top_k tracks; its error is about 3.5 / TRACKED of all rows, well below 1 / PARTS.
TRACKED = 16_384


def hot_keys(rows: DataFrame, key: Column, least: int = 100 * PARTS) -> dict[int, int]:
    """The hashes of the hot keys, fewer than PARTS, and in how many parts to deal each; none where there are fewer than
    `least` rows in all. One pass with a sketch of bounded size; nothing is shuffled."""
    total, top = rows.select(F.xxhash64(key).alias("_hash")).agg(F.count("*"), F.expr(f"approx_top_k(_hash, {PARTS}, {TRACKED})")).first()
    return {r["item"]: -(-r["count"] * PARTS // total) for r in top or [] if r["count"] * PARTS > total >= least}


def salts(key: Column, hot: dict[int, int]) -> Column:
    """In how many parts a row's key is dealt. The expression has the same form whether there are hot keys or not."""
    h, table = F.xxhash64(key), {0: 1} | hot
    entries = F.create_map(*[F.lit(x) for k, n in table.items() for x in (k, n)])
    return F.when(h.isin(*table), F.coalesce(F.element_at(entries, h), F.lit(1))).otherwise(F.lit(1)).cast("int")


def salted(rows: DataFrame, key: Column, by: Column, hot: dict[int, int]) -> DataFrame:
    """rows with a _salt: 0, or for hot keys one of as many as they have, by the hash of `by`."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), salts(key, hot)).cast("int"))


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """big joined to small on `key`, which no two rows of small share. A hot key's rows are dealt by the column `by`, and
    its row of small goes to each of its salts. big should be a written table: it is read twice."""
    hot = hot_keys(big, F.col(key))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts(F.col(key), hot) - 1)))
    return salted(big, F.col(key), F.col(by), hot).join(right, [key, "_salt"], how).drop("_salt")
