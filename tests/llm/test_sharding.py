import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm.sharding import shard_documents

SCHEMA = "doc_id long, text string, shard string"


def check(rows, out, shards, slack):
    assert len(out) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total = sum(r.size for r in out)
    for s in range(shards):
        assert abs(sum(r.size for r in by.get(s, [])) - total / shards) <= slack


@pytest.mark.parametrize("rows_per_task", [2_000_000, 20])
def test_sizes_are_near_equal_with_a_hot_group(spark, rows_per_task):
    rows = [(i, "hot text " * 20, "x") for i in range(700)] + [(1000 + i, f"text {i} é" * (1 + i % 9), None) for i in range(1300)]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), 24, rows_per_task=rows_per_task).collect()
    check(rows, out, 24, 500)


def test_odd_rows(spark):
    rows = [(None, None, "a"), (None, "a", "a"), (3, "", "a"), (3, "", "a"), (4, None, None), (5, "ß" * 100_000, "a")]
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), 3).collect()
    check(rows, out, 3, 300_000)


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = shard_documents(spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("hot", [0, 4000])
def test_20_000_buckets_against_a_sort(spark, hot):
    """Boundaries, sizes and slots of a fine cut against the rows sorted by key; some boundaries lie inside a group."""
    from lodestar.llm import sharding

    keys = spark.range(60_000).select((F.col("id") % 500).alias("size"), F.when(F.col("id") < hot, F.lit(77 << 40)).otherwise(F.shiftrightunsigned(F.xxhash64("id"), 2)).alias("h"), (F.col("id") * 7 - 9000).alias("d")).cache()
    bounds, below = sharding.splitters(keys, 20_000, 1000, 0.0005, 32)
    assert len(bounds) == len(below) == 19_999 and bounds == sorted(bounds)
    ordered = sorted((r.h, r.d, r.size) for r in keys.collect())
    sums = [0]
    for *_, size in ordered:
        sums.append(sums[-1] + size)
    from bisect import bisect_left

    places = [bisect_left(ordered, (h, d)) for h, d in bounds]
    assert places == below
    assert max(abs(sums[p] - sums[-1] * i // 20_000) for i, p in enumerate(places, 1)) <= 500
    rows = sharding._with_bucket(keys, bounds).select("h", "d", "bucket")
    from bisect import bisect_right

    assert all(r.bucket == bisect_right(bounds, (r.h, r.d)) for r in rows.collect())
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_ties_at_a_boundary(spark):
    rows = [(i // 2, "same", "x") for i in range(60)] + [(None, "same", None)] * 3
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), 4).collect()
    check(rows, out, 4, 24)
