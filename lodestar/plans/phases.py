"""Resumable processing: phase logs, what is left to do, their merge, and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Timestamps in saved progress, to the microsecond.
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def latest(log: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """The last row of each key, by seq: a grouped maximum of structs, combined on the map side."""
    rest = [c for c in log.columns if c not in (key, seq)]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def merge(first: DataFrame, second: DataFrame, third: DataFrame, key: str = "path") -> DataFrame:
    """Phase logs into one row a key: the second may add keys, the third only adds columns. Last write wins in each."""
    return latest(first, key).join(latest(second, key), key, "full_outer").join(latest(third, key), key, "left")


def pending(inputs: DataFrame, log: DataFrame, key: str = "path") -> DataFrame:
    """Inputs that no successful row of the log covers; failed ones are tried again."""
    return inputs.join(log.where("success").select(key), key, "left_anti")


def needs_summary(results: DataFrame) -> DataFrame:
    return results.where("success and not has_ai_summary")


def needs_embedding(results: DataFrame) -> DataFrame:
    return results.where("has_ai_summary and embedding is null")


def indexable(results: DataFrame) -> DataFrame:
    return results.where("success").where(F.coalesce(F.nullif("summary", F.lit("")), F.nullif("content_excerpt", F.lit(""))).isNotNull())


def progress(log: DataFrame, total: int | None, by: str = "run") -> DataFrame:
    """Counts, rate and estimated completion of each run from its log (run, timestamp, success)."""
    log = log.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    seconds = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    out = log.groupBy(by).agg(
        F.count("*").alias("files_processed"),
        F.count_if("success").alias("files_successful"),
        F.count_if(~F.col("success")).alias("files_failed"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("_now"),
        seconds.alias("total_processing_time"),
    )
    out = out.withColumn("current_rate", F.when(F.col("total_processing_time") > 0, F.col("files_processed") / F.col("total_processing_time")).otherwise(0.0))
    out = out.withColumn("success_rate", F.col("files_successful") / F.greatest(F.lit(1), F.col("files_processed")))
    left = F.greatest(F.lit(total or 0) - F.col("files_processed"), F.lit(0)) / F.col("current_rate")
    eta = F.when(F.col("current_rate") > 0, F.timestamp_micros((F.unix_micros("_now") + left * 1e6).cast("long")))
    return out.withColumn("estimated_completion", eta if total is not None else F.lit(None).cast("timestamp")).drop("_now")


def save_progress(row: DataFrame, path: str) -> None:
    """One run's progress (a row of progress()) in place of what was saved before."""
    row.limit(1).coalesce(1).write.mode("overwrite").option("timestampFormat", ISO).json(path)


def load_progress(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved row with its times as timestamps, or None where nothing (readable) was saved."""
    from pyspark.errors import AnalysisException

    schema = "run string, files_processed long, files_successful long, files_failed long, start_time timestamp, total_processing_time double, current_rate double, success_rate double, estimated_completion timestamp"
    try:
        saved = spark.read.schema(schema).option("timestampFormat", ISO).json(path)
    except AnalysisException:
        return None
    return None if saved.isEmpty() else saved


def readiness(versions: DataFrame, **artifacts: DataFrame) -> DataFrame:
    """versions with has_<name> for each table of keys, and is_ready: lexical index and ranking are there."""
    key = versions.columns[0]
    out = reduce(lambda df, x: df.join(x[1].select(key).distinct().withColumn(f"has_{x[0]}", F.lit(True)), key, "left"), artifacts.items(), versions)
    out = out.select(*versions.columns, *[F.coalesce(f"has_{a}", F.lit(False)).alias(f"has_{a}") for a in artifacts])
    return out.withColumn("is_ready", F.col("has_lexical") & F.col("has_pagerank"))


def phase_totals(results: DataFrame) -> DataFrame:
    """One row: rows, successes, summaries, embeddings, and the share of each in the step before it."""
    n = results.agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if("has_ai_summary").alias("summarised"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"))
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return n.select("*", share("successful", "total").alias("success_rate"), share("summarised", "successful").alias("summary_rate"), share("embedded", "summarised").alias("embedding_rate"))


def save_metadata(spark, values: dict[str, str], path: str) -> None:
    """Run metadata as one row a key, stamped."""
    spark.createDataFrame(list(values.items()), "key string, value string").withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(path)


def archive(spark, path: str, stamp: str) -> str | None:
    """Move a checkpoint folder to path-<stamp>, through Hadoop's file system, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    target = f"{path}-{stamp}"
    return target if fs.exists(p(path)) and fs.rename(p(path), p(target)) else None
