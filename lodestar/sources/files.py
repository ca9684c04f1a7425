"""Reading and writing: source trees, archives, analysis documents, ranked files, indexes."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import extract, naming
from ..functions.text import content_hash, strip, words
from ..schemas import ANALYSIS, FILE_INFO, RANKED
from ..storage import materialise, numbered
from .archive import BATCH_BYTES, PARTITION_BYTES, SUFFIXES, directory_place, entries, opened, read_archives
from .archive import content as entry_content

#: Fixed value: the archive's member that names its version.
VERSION_MEMBER = "checkout/fndbas/source/version.txt"
#: Names in a batch of a listing; files and bytes of a tree that a task reads at most.
LISTED_ROWS, TASK_FILES, TASK_BYTES = 10_000, 10_000, 32 << 20


def _home(spark: SparkSession, root: str) -> str:
    """The root as Spark writes it before the paths of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def listed_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, size) of all files below root, written as a table.

    Of a mounted folder, which driver and executors share, tasks list the folders of one level after the other, each in
    pieces, so that neither the driver nor a task holds the names of a tree. Links are followed; what has gone or cannot
    be read is left out. On other stores the driver lists, as Spark's file sources do."""
    home = _home(spark, root)
    if not home.startswith("file:"):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
        return raw.select("path", F.substring("path", len(home) + 2, 2**31 - 1).alias("relative_path"), F.col("length").alias("size"))
    top = home.removeprefix("file:")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["relative_path", "size"])
        for given in batches:
            for folder in given["folder"].to_pylist():
                rows: list[tuple[str, int | None]] = []
                for name, size in _entries(f"{top}/{folder}"):
                    rows.append((f"{folder}/{name}" if folder else name, size))
                    if len(rows) == LISTED_ROWS:
                        yield batch(rows)
                        rows.clear()
                if rows:
                    yield batch(rows)

    out, folders, n = [], spark.createDataFrame([("",)], "folder string"), 1
    while n:
        found = materialise(folders.repartition(min(n, spark.sparkContext.defaultParallelism * 4)).mapInArrow(scan, "relative_path string, size long"), "listing")
        out.append(found.where("size is not null"))
        folders = found.where("size is null").select(F.col("relative_path").alias("folder"))
        n = folders.count()
    return reduce(DataFrame.unionByName, out).select(F.concat(F.lit(f"{home}/"), "relative_path").alias("path"), "relative_path", "size")


def _entries(folder: str) -> Iterator[tuple[str, int | None]]:
    """(name, size) of what a folder holds, without a size for folders."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_dir():
                        yield e.name, None
                    elif e.is_file() and os.access(e.path, os.R_OK):
                        yield e.name, e.stat().st_size
                except OSError:  # gone
                    continue
    except (FileNotFoundError, NotADirectoryError):  # gone
        return


def source_tree(spark: SparkSession, root: str, suffix: str = ".plsql", max_files: int | None = None) -> DataFrame:
    """file_path, relative_path, file_name, file_size_mb, content of all files below root with the suffix, in path order
    if limited. Bytes that are no UTF-8 are dropped. A file that cannot be read or has gone is left out; no file of the
    kind is an error. The tree is listed once, by tasks (listed_tree()), and read by as many as its files and bytes ask for."""
    listed = listed_tree(spark, root).where(F.endswith("relative_path", F.lit(suffix)))
    if max_files is not None:
        listed = listed.orderBy("relative_path").limit(max_files)
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        raise ValueError(f"no *{suffix} file below {root}")
    if _home(spark, root).startswith("file:"):
        tasks = max(-(-n // TASK_FILES), -(-size // TASK_BYTES), min(n, spark.sparkContext.defaultParallelism))
        raw = listed.select("path", "relative_path").repartition(tasks, "relative_path").mapInArrow(_read, "path string, relative_path string, length long, raw binary")
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
        found = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
        raw = found.join(listed.select("path", "relative_path"), "path").select("path", "relative_path", "length", F.col("content").alias("raw"))
    plain = F.col("raw").cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(F.replace(F.make_valid_utf8(plain), F.lit("\ufffd"), F.lit("")))
    out = raw.select(F.col("path").alias("file_path"), "relative_path", naming.file_name(F.col("path")).alias("file_name"), (F.col("length") / 1048576.0).alias("file_size_mb"), text.alias("content"))
    return out if max_files is None else out.orderBy("relative_path")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of a mounted folder with their bytes, in batches of some megabytes."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "relative_path", "length", "raw"])
    rows, held = [], 0
    for given in batches:
        for path, relative in zip(given["path"].to_pylist(), given["relative_path"].to_pylist(), strict=True):
            try:
                with open(path.removeprefix("file:"), "rb") as f:
                    raw = f.read()
            except OSError:  # gone
                continue
            rows.append((path, relative, len(raw), raw))
            held += len(raw)
            if held >= BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
    if rows:
        yield batch(rows)


def file_info(tree: DataFrame) -> DataFrame:
    """The analysis record of every file: names, calls, change notes, declared names; a projection of the scan."""
    c = F.col("content")
    return tree.select(
        "file_path",
        "relative_path",
        "file_name",
        naming.api_name(naming.base_name(F.col("file_name"))).alias("api_name"),
        "file_size_mb",
        extract.api_calls(c).alias("api_calls"),
        extract.change_notes(c).alias("changelog_lines"),
        extract.declared_names(c).alias("procedure_function_names"),
        content_hash(c).alias("content_hash"),
    )


def archive_version(path: str) -> str:
    """The version named in an archive: the first word of the first line that is neither blank nor a comment. The
    archive's directory is walked in pieces; the driver holds the one member only."""
    file, size = opened(path)
    with file:
        begin, end, shift = directory_place(file, size)
        member = None
        for _, _, e in entries(file, begin, end, shift):
            member = e if e.name == VERSION_MEMBER else member  # of members of one name the last counts
        if member is None:
            raise ValueError(f"{VERSION_MEMBER} not found")
        for line in entry_content(file, member).decode("utf-8").split("\n"):
            if line.strip() and not line.strip().startswith(("#", "//")):
                return line.split()[0]
    raise ValueError("no version in the archive")


def archive_versions(spark: SparkSession, path: str) -> DataFrame:
    """(archive, version) of the archive at path or of those of a folder, by the rule of archive_version(); of archives
    only that one member is read. One without a version has null."""
    member = read_archives(spark, path, names=VERSION_MEMBER)
    named = F.filter(F.transform(F.split(F.col("content").cast("string"), "\n"), strip), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//"))
    return member.select("archive", F.get(words(F.get(named, F.lit(0))), F.lit(0)).alias("version"))


def archive_entries(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(archive, relative_path, content) of the source files in the ZIP archive at path, or in those of a folder: entries
    below the archive's root whose suffix is known, in any case; the root is cut off. An archive of any size is read by
    as many tasks as its compressed bytes ask for."""
    found = read_archives(spark, path, sourcesOnly="true", partitionBytes=partition_bytes)
    return found.select("archive", F.col("entry").alias("relative_path"), "content")


def import_archive(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Write an archive's source files as a table (partition-free Parquet) that replaces what was at target."""
    archive_entries(spark, path).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def extract_archive(spark: SparkSession, path: str, target: str) -> int:
    """Write an archive's source files below target, which they replace as a whole; how many there are. Executors write
    the files, to a folder beside target that takes its place at the end, so target must be a folder that all of them
    share (on stores without one use import_archive). An unsafe name stops the import and leaves target as it was."""
    new = f"{target}.new-{uuid.uuid4().hex}"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for relative, content in zip(batch["relative_path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                place = os.path.join(new, relative)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "wb") as file:
                    file.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    try:
        n = archive_entries(spark, path).mapInArrow(f, "n long").agg(F.sum("n")).first()[0] or 0
        os.makedirs(new, exist_ok=True)
        shutil.rmtree(target, ignore_errors=True)
        os.rename(new, target)
    except Exception as e:
        shutil.rmtree(new, ignore_errors=True)
        if "unsafe name" in str(e):
            raise ValueError(re.search(r"unsafe name in the archive: .*", str(e)).group()) from e
        raise
    return n


def write_contents(tree: DataFrame, ranked: DataFrame, path: str, parts: int = 64) -> None:
    """What a search shows of a file: path, file_name, api_name, rank, pagerank_score, content, clustered by path in small
    pages, so that a search reads the pages of its hits only. ranked: file records with their ranks."""
    ranks = ranked.select("relative_path", "file_name", "api_name", F.col("pagerank_rank").alias("rank"), F.col("pagerank_score").cast("double").alias("pagerank_score"))
    rows = tree.select("relative_path", "content").join(ranks, "relative_path").withColumnRenamed("relative_path", "path")
    dealt = rows.repartitionByRange(parts, "path").sortWithinPartitions("path")
    dealt.write.option("parquet.block.size", 8 << 20).option("parquet.page.row.count.limit", 64).mode("overwrite").parquet(path)


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below root; their contents are not read."""
    return listed_tree(spark, root).select("path", "size")


def count_by_extension(listing: DataFrame) -> DataFrame:
    """(version, extension, n) of the source files of a listing of versions; the sum over extensions is file_count."""
    version = F.regexp_extract("path", r"/versions/([^/]+)/", 1).alias("version")
    extension = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return listing.select(version, extension.alias("extension")).where(F.col("extension").isin(*SUFFIXES)).groupBy("version", "extension").agg(F.count("*").alias("n"))


#: How the document that write_analysis() writes begins; its records stand on lines of their own.
_HEAD = '{"analysis_metadata":{"layout":"lines",'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The document's lines (value), without the comma that parts one from the line before."""
    return spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("value"))


def read_analysis(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The file records of an analysis document, with their order. One that write_analysis() has written is read line by
    line, by as many tasks as it has bytes for; any other JSON document is parsed as a whole, by one."""
    if spark.read.text(path).where(F.startswith("value", F.lit(_HEAD))).isEmpty():
        rows = spark.read.schema(ANALYSIS).option("multiLine", "true").json(path).select(F.posexplode("file_info").alias("file_order", "f")).select("file_order", "f.*")
    else:
        record = F.from_json("value", StructType([StructField("file_order", IntegerType()), *FILE_INFO.fields])).alias("f")
        rows = _lines(spark, path).where(F.startswith("value", F.lit('{"file_order":'))).select(record).select("f.*")
    return rows if max_files is None else rows.orderBy("file_order").limit(max_files)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(src, targets) of the reference graph of an analysis document."""
    kind = ANALYSIS["reference_graph"].dataType
    if spark.read.text(path).where(F.startswith("value", F.lit(_HEAD))).isEmpty():
        graph = spark.read.schema(ANALYSIS).option("multiLine", "true").json(path).select(F.explode("reference_graph").alias("src", "targets"))
    else:
        links = _lines(spark, path).where(F.startswith("value", F.lit('"')))
        graph = links.select(F.explode(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), kind)).alias("src", "targets"))
    return graph


def global_stats(info: DataFrame) -> DataFrame:
    """One row: files found and processed, and calls found."""
    calls = F.coalesce(F.sum(F.size("api_calls")), F.lit(0)).cast("long")
    return info.agg(F.count("*").alias("total_files_found"), F.count("*").alias("total_files_processed"), calls.alias("total_api_calls_found"))


def write_analysis(info: DataFrame, graph: DataFrame, path: str, work_directory: str) -> None:
    """One JSON document with all file records, in path order, and the reference graph, for exchange with other tools:
    a folder of parts that are the document when they are read one after the other by name (single_file() joins them).

    Records and links stand on lines of their own. Both are numbered across partitions by prefix sums, so that a line
    knows whether a comma comes before it; then all lines are range-partitioned by their place and written where they
    lie. No task and not the driver holds the document."""
    spark = info.sparkSession
    stats = global_stats(info).first().asDict()
    meta = {"layout": "lines", "work_directory": work_directory, "max_context_tokens": 65536, "analysis_timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), "processing_stats": stats}
    head = _HEAD + json.dumps(meta, separators=(",", ":")).removeprefix('{"layout":"lines",')
    marks = spark.createDataFrame([(0, 0, head + ',"file_info":['), (2, 0, '],"reference_graph":{'), (4, 0, "}}")], "section int, at long, value string")
    comma = F.when(F.col("at") > 0, ",").otherwise("")
    records = numbered(info.select(*[f.name for f in FILE_INFO.fields]), F.col("relative_path"), F.col("file_path"), name="at")
    record = F.to_json(F.struct(F.col("at").alias("file_order"), *[f.name for f in FILE_INFO.fields]))
    links = numbered(graph.select("src", F.coalesce("targets", F.array().cast("array<string>")).alias("targets")), F.col("src"), name="at")
    link = F.to_json(F.create_map("src", "targets"))
    lines = marks.unionByName(records.select(F.lit(1).alias("section"), "at", F.concat(comma, record).alias("value")))
    lines = lines.unionByName(links.select(F.lit(3).alias("section"), "at", F.concat(comma, F.substring(link, F.lit(2), F.length(link) - 2)).alias("value")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "section", "at").sortWithinPartitions("section", "at").select("value").write.mode("overwrite").text(path)


def single_file(spark: SparkSession, folder: str, target: str) -> int:
    """Join the parts that lie in a folder, by name, into one file at target; its bytes. Both must lie where driver and
    executors share folders. The driver reads the parts' lengths; a task copies a part to the place where it belongs."""
    parts = sorted(e.path for e in os.scandir(folder) if e.name.startswith("part-"))
    ends = list(accumulate((os.path.getsize(p) for p in parts), initial=0))
    new = f"{target}.new-{uuid.uuid4().hex}"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at in zip(batch["part"].to_pylist(), batch["at"].to_pylist(), strict=True):
                with open(part, "rb") as source, open(new, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(source, out, 1 << 20)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    with open(new, "wb") as out:
        out.truncate(ends[-1])
    if parts:
        places = spark.createDataFrame(list(zip(parts, ends[:-1], strict=True)), "part string, at long").repartition(len(parts), "part")
        places.mapInArrow(f, "n long").agg(F.sum("n")).collect()
    os.replace(new, target)
    return ends[-1]


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """Ranked files, a JSON object a line; blank lines are skipped."""
    return spark.read.schema(RANKED).json(path)


def write_ranked(ranked: DataFrame, path: str) -> None:
    """Ranked files as JSON lines: parts that are in rank order when they are read one after the other by name."""
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked.repartitionByRange(parts, "pagerank_rank").sortWithinPartitions("pagerank_rank").write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append processing results, stamped."""
    rows.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def publishable(listing: DataFrame) -> DataFrame:
    """Files of a version (path) that hold no source text: indexes, vectors and the ranking; with a description."""
    table = F.regexp_extract("path", r"(?:^|/)lexical/([^/]+)", 1)
    kind = F.when(F.col("path").rlike("(?:^|/)vectors/"), "vector table").when(table != "", F.concat(F.lit("lexical index, "), table)).when(F.col("path").rlike(r"(?:^|/)ranked\.jsonl(?:/|$)"), "file ranking")
    return listing.withColumn("description", kind).where("description is not null")


def newer_release(tags: DataFrame, latest: str) -> DataFrame:
    """Tags (tag) of the form [v]x.y.z that are greater than the latest one."""
    bare = lambda c: F.regexp_replace(c, "^v+", "")
    parts = lambda c: F.transform(F.split(bare(c), r"\."), lambda x: x.cast("int"))
    return tags.where(bare(F.col("tag")).rlike(r"^\d+\.\d+\.\d+$")).where(parts(F.col("tag")) > parts(F.lit(latest)))
