from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.joins import PARTS, hot_keys, salted, spread_join


def test_a_hot_key_is_spread_and_no_row_lost(spark):
    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    small = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y")).union(spark.createDataFrame([(7, 70)], "k long, y long"))
    hot = hot_keys(big, F.col("k"))
    assert 1 <= len(hot) < PARTS
    assert salted(big, F.col("k"), F.col("x"), hot).where("k = 7").select("_salt").distinct().count() > 100
    for how in ("inner", "left"):
        assert spread_join(big, small, "k", "x", how).exceptAll(big.join(small, "k", how)).isEmpty()
        assert spread_join(big, small, "k", "x", how).count() == big.join(small, "k", how).count()
    assert hot_keys(big.limit(100), F.col("k")) == hot_keys(big.limit(0), F.col("k")) == {}


def test_components_with_a_hub(spark):
    edges = spark.range(1, 50_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.createDataFrame([(60_000, 60_001)], "a long, b long"))
    assert sorted(r["count"] for r in components(edges).groupBy("root").count().collect()) == [2, 50_001]
