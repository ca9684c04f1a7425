"""EXTENSION: file-change tracking. Listings of a tree come in as a stream; out come the files that were added, changed or
removed since the listing before, and a table of tokenised documents follows them, from which the index is made.

A listing is split over buckets by a hash of the path. A bucket's state is what its files were when last seen; a listing
compares with it as a whole, so that what is missing is known to have gone. Only what has changed is read and tokenised."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

LISTING = "bucket int, listing long, path string, hash string"
CHANGE = "bucket int, listing long, change string, path string, hash string"
#: State that a map needs: on executors' disks, with its changes in the checkpoint.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bucket_of(path, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def write_listing(listing: DataFrame, number: int, folder: str, buckets: int = 64) -> None:
    """Add (path, hash) of all files, as listing `number`, to the folder that the stream reads. A bucket's rows lie in
    one file, with a row without a path that says that the bucket was listed: also an empty bucket is, and whoever sees
    the file sees the whole bucket. Numbers must grow. Rows without a path or hash are left out."""
    spark = listing.sparkSession
    rows = listing.where("path is not null and hash is not null").select(bucket_of(F.col("path"), buckets).alias("bucket"), F.lit(number).cast("long").alias("listing"), "path", "hash")
    marks = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(number).cast("long").alias("listing"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("hash"))
    rows.unionByName(marks).repartition(buckets, "bucket").write.mode("append").parquet(folder)


class _Tracker(StatefulProcessor):
    """A bucket's files and the number of the listing that said so. The state is read once and only changes are written."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "hash string")
        self.last = handle.getValueState("last", "listing long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        listings: dict[int, dict[str, str]] = {}
        for pdf in rows:
            for listing, path, hash_ in zip(pdf["listing"].tolist(), pdf["path"].tolist(), pdf["hash"].tolist(), strict=True):
                found = listings.setdefault(int(listing), {})
                if isinstance(path, str):
                    found[path] = max(hash_, found.get(path, ""))  # a path that a listing repeats
        last = self.last.get()[0] if self.last.exists() else -(2**62)
        known = {k[0]: v[0] for k, v in self.files.iterator()} if self.files.exists() else {}
        out = []
        for listing in sorted(n for n in listings if n > last):  # one that comes too late says nothing any more
            now = listings[listing]
            for path, hash_ in now.items():
                if known.get(path) != hash_:
                    out.append((key[0], listing, "update" if path in known else "insert", path, hash_))
                    self.files.updateValue((path,), (hash_,))
            for path in known.keys() - now.keys():
                out.append((key[0], listing, "delete", path, None))
                self.files.removeKey((path,))
            known, last = now, listing
            self.last.update((listing,))
        yield pd.DataFrame(out, columns=["bucket", "listing", "change", "path", "hash"])

    def close(self) -> None:
        pass


def changes(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of changes (bucket, listing, change, path, hash) that the listings in a folder make."""
    spark.conf.set(PROVIDER, ROCKS)
    listed = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return listed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Tracker(), outputStructType=CHANGE, outputMode="Update", timeMode="None")


def _manifest(spark: SparkSession, table: str, upto: int | None = None) -> dict[int, int]:
    """Which batch wrote each bucket last, as of the newest manifest, or of the newest before batch `upto`."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("batch long, buckets string").option("recursiveFileLookup", "true").json(f"{table}/manifests").where("batch is not null")
        row = (rows if upto is None else rows.where(F.col("batch") < upto)).orderBy(F.desc("batch")).first()  # one row a batch
    except AnalysisException:
        return {}
    return {int(k): v for k, v in json.loads(row["buckets"]).items()} if row else {}


def documents(spark: SparkSession, table: str, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """(doc_id, tokens) of the documents that there are now."""
    held = _manifest(spark, table, upto)
    paths = [f"{table}/batch={v}/bucket={k}" for k, v in sorted(held.items()) if buckets is None or k in buckets]
    reader = spark.read.schema("doc_id string, tokens array<string>")
    return reader.parquet(*paths) if paths else spark.createDataFrame([], "doc_id string, tokens array<string>")


def apply_changes(batch: DataFrame, number: int, table: str, contents: Callable[[DataFrame], DataFrame]) -> None:
    """Write the buckets that a batch of changes touches anew, as generation `number`, and then the manifest that makes
    them the current ones. contents((path, hash) of added and changed files) gives their (doc_id, tokens). A batch that is
    run again builds on the manifest before it and writes the same."""
    spark = batch.sparkSession
    rows = batch.persist()
    try:
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return
        last = rows.groupBy("bucket", "path").agg(F.max_by(F.struct("change", "hash"), "listing").alias("x")).select("bucket", "path", "x.*")
        new = contents(last.where("change <> 'delete'").select("path", "hash")).join(last.select(F.col("path").alias("doc_id"), "bucket"), "doc_id")
        n = spark.conf.get("lodestar.change.buckets")
        old = documents(spark, table, number, touched).withColumn("bucket", bucket_of(F.col("doc_id"), int(n)))
        kept = old.join(last.select(F.col("path").alias("doc_id")), "doc_id", "left_anti")
        empty = spark.createDataFrame([(b,) for b in touched], "bucket int").select(F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("array<string>").alias("tokens"), "bucket")
        every = kept.unionByName(new.select("doc_id", "tokens", "bucket")).unionByName(empty)  # a bucket that has lost all its files is written too
        every.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")
        held = _manifest(spark, table, number) | dict.fromkeys(touched, number)
        line = spark.createDataFrame([(number, json.dumps(held))], "batch long, buckets string")
        line.coalesce(1).write.mode("overwrite").json(f"{table}/manifests/{number:012d}")
    finally:
        rows.unpersist()


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, contents: Callable[[DataFrame], DataFrame], buckets: int = 64, files_per_batch: int = 1000) -> StreamingQuery:
    """Run the changes of all listings that have come since into the table; awaitTermination() ends when none is left.
    Listings must have been written with as many buckets."""
    spark.conf.set("lodestar.change.buckets", str(buckets))
    stream = changes(spark, folder, files_per_batch)
    return stream.writeStream.foreachBatch(lambda batch, number: apply_changes(batch, number, table, contents)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
