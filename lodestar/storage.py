"""Written tables that cut a plan's lineage, in the folder that driver and executors share.

Who deletes them: a query returns a frame that reads some of them later, so it cannot. The caller does, with release()
once it has its rows; the command line does at its end, and a cluster may clear spark.checkpoint.dir by age."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_WRITTEN: list[str] = []
_MEMOS: list[dict] = []


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, only where that is unset and driver and executors are one process, a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder, which release() deletes."""
    path = f"{scratch_root(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def once(f: Callable) -> Callable:
    """f, whose results are kept for its arguments until release()."""
    memo: dict[tuple, object] = {}
    _MEMOS.append(memo)

    @wraps(f)
    def g(*args):
        if args not in memo:
            memo[args] = f(*args)
        return memo[args]

    return g


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again. The table stays until release() or whatever cleans
    that folder, since frames that are read later may depend on it. options: of the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """The rows with their number, from 0, in an order that leaves no ties open, without one task that holds all rows:
    they are range-partitioned by the order and sorted, and written with their number inside the partition; a
    partition's offset is the rows before it. Offsets are as many as partitions and are broadcast."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = materialise(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    counts = written.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return written.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias(name))


def release(spark: SparkSession) -> int:
    """Delete the tables and other scratch that this process has written, and forget what was kept of them, once no frame needs them any more; how many there were."""
    n = len(_WRITTEN)
    for memo in _MEMOS:
        memo.clear()
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
