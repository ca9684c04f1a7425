"""BM25 over tables: postings, terms and corpus statistics, written once and queried by joins.

A stored index holds its postings in blocks: the documents are cut into slices where they lie, and a row holds what one
term has in one slice, as arrays of places within the slice, frequencies and lengths, with the most that any of them can
add to a score. Rows lie in the order of (term, slice) in small pages, so that a query's terms prune the scan; the bounds
tell which slices can hold one of the k best at all. Blocks are made by the tasks that read the documents' counts, and
are exchanged once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LANGUAGE_KEYWORDS
from ..storage import materialise

K1, B = 1.5, 0.75
#: Up to so many terms of queries are broadcast, some megabytes; more are joined by a shuffle.
BROADCAST_TERMS = 100_000


def document_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df) over lower-cased words of three characters or more."""
    terms = F.array_distinct(F.transform(F.col(tokens), F.lower))
    return docs.select(F.explode(terms).alias("term")).where(F.length("term") > 2).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stopwords(docs: DataFrame, share: float = 0.8, tokens: str = "tokens") -> DataFrame:
    """(term, df) of words in more than `share` of the documents, language keywords apart."""
    n = docs.agg(F.count("*").alias("n"))
    df = document_frequency(docs, tokens).where(~F.col("term").isin(*LANGUAGE_KEYWORDS))
    return df.join(F.broadcast(n)).where(F.col("df") > F.col("n") * share).select("term", "df")  # n: one row


#: Documents of a slice.
SLICE_DOCS = 4_096
#: Rows of a page of the blocks' table: what a scan reads at least.
PAGE_ROWS = 32
#: Integers of a block as their differences, which take half of their plain bytes.
PACKED = {"parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.writer.version": "v2"}
#: Postings of a file of the blocks' table, some 40 MB: what a task sorts.
FILE_POSTINGS = 5_000_000
#: Postings that a task holds until it makes blocks of them; a slice is cut from twice as many on.
HELD_POSTINGS = 1_500_000
#: A block's bound is a whole number of these fractions, rounded up.
BOUND_STEPS = 1_024
#: Up to so many (query, term) pairs come to the driver, which puts them into the scan's filter.
PRUNED_TERMS = 10_000
#: Parquet takes lists up to so many values as they are; of longer ones it sees the range (Spark's own default is 10).
IN_LIST, IN_LIST_VALUES = "spark.sql.parquet.pushdown.inFilterThreshold", 256
#: Of monotonically_increasing_id(): the bits that number a partition's rows.
ROW_BITS = 33


@dataclass
class LexicalIndex:
    postings: DataFrame  # term, doc_id, tf, dl
    terms: DataFrame  # term, df, idf
    docs: DataFrame  # doc_id, dl
    stats: DataFrame  # n, avgdl
    counted: DataFrame  # at, doc_id, dl, terms, tfs: a row a document, numbered where it lies

    def write(self, path: str, buckets: int = 64, slice_docs: int = SLICE_DOCS) -> None:
        """The stored form below path, in buckets files or more. A block has slice_docs postings at most, whatever the
        term; a term has one in a slice, or some where a slice is large or lies in parts. Postings are grouped where
        their documents lie, so that the blocks alone are exchanged; document frequencies follow from the blocks."""
        spark = self.docs.sparkSession
        stats = self.stats.first()
        spark.createDataFrame([(stats["n"], stats["avgdl"], slice_docs)], "n long, avgdl double, slice_docs int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        placed = in_slices(self.counted, slice_docs)
        placed.select("doc_id", "dl", "slice", "place").repartitionByRange(buckets, "slice").sortWithinPartitions("slice", "place").write.mode("overwrite").parquet(f"{path}/docs")
        n = self.counted.agg(F.sum(F.size("terms"))).first()[0] or 0
        dealt = blocks(placed, stats["avgdl"]).repartitionByRange(max(buckets, -(-n // FILE_POSTINGS)), "term", "slice").sortWithinPartitions("term", "slice")
        unpacked(dealt).write.options(**PACKED).mode("overwrite").parquet(f"{path}/blocks")
        df = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
        df.repartitionByRange(buckets, "term").sortWithinPartitions("term").write.options(**PACKED).mode("overwrite").parquet(f"{path}/terms")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> StoredIndex | None:
        """The stored index, or None if one of its tables is missing."""
        from pyspark.errors import AnalysisException

        try:
            blocks, docs, stats, terms = (spark.read.parquet(f"{path}/{name}") for name in StoredIndex.TABLES)
        except AnalysisException:
            return None
        if spark.conf.get(IN_LIST) == "10":
            spark.conf.set(IN_LIST, str(IN_LIST_VALUES))
        n, avgdl, slice_docs = stats.first()
        return StoredIndex(blocks, docs, stats, terms.select("term", "df", idf(F.lit(n), F.col("df")).alias("idf")), n, avgdl, slice_docs)


@dataclass
class StoredIndex:
    blocks: DataFrame  # term, slice, bound (of BOUND_STEPS), places, tfs, dls
    docs: DataFrame  # doc_id, dl, slice, place
    stats: DataFrame  # n, avgdl, slice_docs
    terms: DataFrame  # term, df, idf
    n: int
    avgdl: float | None
    slice_docs: int

    TABLES = ("blocks", "docs", "stats", "terms")

    @property
    def postings(self) -> DataFrame:
        one = self.blocks.select("term", "slice", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p"))
        return one.select("term", "slice", F.col("p.places").alias("place"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")).join(self.docs.select("doc_id", "slice", "place"), ["slice", "place"]).select("term", "doc_id", "tf", "dl")

    def weighed(self, asked: DataFrame) -> DataFrame:
        """asked, which carries term and perhaps idf, with idf."""
        return asked if "idf" in asked.columns else asked.join(self.terms.select("term", "idf"), "term")

    def scored(self, asked: DataFrame) -> DataFrame:
        """(query_id, slice, place, score) of blocks that carry query_id and times. Scores are rounded, so that ties do
        not depend on the order of a sum."""
        one = self.weighed(asked).select("query_id", "slice", (F.col("times") * F.col("idf")).alias("weight"), F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p"))
        score = F.sum(F.col("weight") * saturated(F.col("p.tfs"), F.col("p.dls"), F.lit(self.avgdl)))
        return one.groupBy("query_id", "slice", F.col("p.places").alias("place")).agg(F.round(score, 9).alias("score"))

    def scored_in_slices(self, asked: DataFrame, few: bool) -> DataFrame:
        """(query_id, slice, place, score) for many pairs (query_id, term, times), broadcast if few: blocks that are asked
        for are exchanged once, by their slices, whatever the number of queries, and scores are summed where they lie."""
        pairs = asked.join(self.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
        held = lambda x: F.broadcast(x) if few else x
        wanted = self.blocks.join(held(asked.select("term").distinct()), "term", "left_semi").repartition(self.n // self.slice_docs + 1, "slice")
        one = wanted.select("term", "slice", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p")).select("term", "slice", F.col("p.places").alias("place"), saturated(F.col("p.tfs"), F.col("p.dls"), F.lit(self.avgdl)).alias("part"))
        return one.join(held(pairs), "term").groupBy("query_id", "slice", "place").agg(F.round(F.sum(F.col("weight") * F.col("part")), 9).alias("score"))

    def promising(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, slice) that can hold one of the k best: those whose terms' bounds add up to the score that the
        k-th best of the query's most promising slice has. asked: blocks that carry query_id and times."""
        asked = self.weighed(asked)
        bounds = asked.groupBy("query_id", "slice").agg(F.sum(F.col("times") * F.col("idf") * F.col("bound") / BOUND_STEPS).alias("most"))
        first = Window.partitionBy("query_id")
        best = bounds.withColumn("n", F.row_number().over(first.orderBy(F.desc("most"), "slice"))).where("n = 1").select("query_id", "slice")
        sure = self.scored(asked.join(best, ["query_id", "slice"])).withColumn("n", F.row_number().over(first.orderBy(F.desc("score"), "place"))).where(F.col("n") == k)
        kept = bounds.join(sure.select("query_id", "score"), "query_id", "left")
        return kept.where(F.col("score").isNull() | (F.col("most") >= F.col("score") - 1e-8)).select("query_id", "slice")


def in_slices(counted: DataFrame, slice_docs: int) -> DataFrame:
    """The documents' counts with slice and place. A partition's rows, in the order in which they were written, are cut
    into slices of their own, so that a slice lies in one file; the slices before a partition are as many rows as
    partitions, and are broadcast."""
    part, row = F.shiftright("at", ROW_BITS), F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    cut = lambda c: F.floor(c / slice_docs)
    parts = counted.groupBy(part.alias("_part")).agg((cut(F.max(row)) + 1).alias("_n"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = counted.withColumn("_part", part).join(F.broadcast(before), "_part")
    return rows.select("doc_id", "dl", (F.col("_before") + cut(row)).cast("int").alias("slice"), (row % slice_docs).cast("short").alias("place"), "terms", "tfs")


def blocks(placed: DataFrame, avgdl: float | None) -> DataFrame:
    """(term, slice, bound, x, wide) of documents' counts with their slices and places: what each term has in a slice,
    grouped within the tasks that read them. For the exchange places, frequencies and lengths are one array: x, or wide
    where a document has more words than a short takes."""
    return placed.select("slice", "place", F.col("dl").cast("int").alias("dl"), "terms", "tfs").mapInArrow(lambda batches: in_blocks(batches, avgdl), "term string, slice int, bound short, x array<short>, wide array<int>")


def in_blocks(batches: Iterator[pa.RecordBatch], avgdl: float | None) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows: slices are gathered until they have HELD_POSTINGS postings, and one that has twice as many
    is cut."""
    held, n = [], 0
    for batch in (x for b in batches for x in _pieces(b)):
        held.append(batch)
        n += len(batch["terms"].flatten())
        if n < HELD_POSTINGS:
            continue
        rows = pa.Table.from_batches(held)
        slices = rows["slice"].to_numpy()
        begins = int(np.flatnonzero(slices != slices[-1])[-1]) + 1 if slices[0] != slices[-1] else 0
        begins = len(rows) if n >= 2 * HELD_POSTINGS and not begins else begins  # of the last slice, which may go on
        if begins:
            yield from _grouped(rows.slice(0, begins), avgdl)
            held = rows.slice(begins).to_batches()
            n = sum(len(b["terms"].flatten()) for b in held)
    if held:
        yield from _grouped(pa.Table.from_batches(held), avgdl)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with up to HELD_POSTINGS postings, or of one row."""
    ends, start = np.cumsum(pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False)), 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + HELD_POSTINGS, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def unpacked(packed: DataFrame) -> DataFrame:
    """(term, slice, bound, places, tfs, dls) of what blocks() gives."""
    part = lambda i: F.slice("x", (F.col("n") * i + 1).cast("int"), F.col("n"))
    one = packed.select("term", "slice", "bound", F.coalesce(F.col("x").cast("array<int>"), "wide").alias("x")).withColumn("n", F.floor(F.size("x") / 3).cast("int"))
    return one.select("term", "slice", "bound", part(0).cast("array<short>").alias("places"), part(1).alias("tfs"), part(2).alias("dls"))


def _grouped(rows: pa.Table, avgdl: float | None) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows, by slice and term; places within a block are in the order of the rows."""
    rows = rows.combine_chunks()
    lists = rows["terms"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    if not len(words):
        return
    each = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    in_order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(in_order), np.int64)
    rank[in_order] = np.arange(len(in_order))
    slices = rows["slice"].to_numpy()
    key = slices[each].astype(np.int64) * len(rank) + rank[words.indices.to_numpy()]
    order = np.argsort(key, kind="stable")
    key, each = key[order], each[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tfs, dls = rows["tfs"].combine_chunks().flatten().to_numpy()[order], rows["dl"].to_numpy()[each]
    bound = np.ceil(np.maximum.reduceat(saturated(tfs.astype(float), dls, avgdl), starts) * BOUND_STEPS)
    sizes = np.diff(np.append(starts, len(key)))
    at = np.arange(len(key)) + np.repeat(2 * starts, sizes)  # 3 * start and the place in the block
    x = np.empty(3 * len(key), np.int32)
    for i, values in enumerate((rows["place"].to_numpy()[each], tfs, dls)):
        x[at + np.repeat(i * sizes, sizes)] = values
    listed = pa.ListArray.from_arrays(pa.array(3 * np.append(starts, len(key)).astype(np.int32)), pa.array(x))
    terms = words.dictionary.take(pa.array(in_order[key[starts] % len(rank)]))
    found = pa.table({"term": terms, "slice": pa.array(slices[each[starts]]), "bound": pa.array(bound.astype(np.int16)), "x": listed})
    wide = np.maximum.reduceat(dls, starts) > np.iinfo(np.int16).max  # a term is in a document at most as often as words are
    for mask, kind, name, other in ((~wide, pa.int16(), "x", "wide"), (wide, pa.int32(), "wide", "x")):
        some = found.filter(pa.array(mask))
        both = {name: some["x"].cast(pa.list_(kind)), other: pa.nulls(len(some), pa.list_(pa.int32() if other == "wide" else pa.int16()))}
        yield from pa.table([some["term"], some["slice"], some["bound"], both["x"], both["wide"]], ["term", "slice", "bound", "x", "wide"]).to_batches(max_chunksize=50_000)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturated(tf: Column | np.ndarray, dl: Column | np.ndarray, avgdl: Column | float) -> Column | np.ndarray:
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def term_counts(tokens: Column) -> tuple[Column, Callable[[str], Column], Callable[[str, str], tuple[Column, Column]]]:
    """How often an array holds each of its values, without an exchange: the array is sorted, and its runs are counted.
    Three steps, each a projection over the one before, so that no array is made twice: the sorted array, the places
    where its runs begin, and from both the values and how often each is there."""
    starts = lambda s: F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))).otherwise(F.array().cast("array<int>"))
    ends = lambda s, at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
    counts = lambda s, at: F.when(F.size(at) > 0, F.zip_with(at, ends(s, at), lambda a, b: b - a)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.array_compact(tokens)), starts, lambda s, at: (F.transform(at, lambda i: F.get(s, i)), counts(s, at))


def build_index(docs: DataFrame, tokens: str = "tokens", stopwords: DataFrame | None = None) -> LexicalIndex:
    """docs: (doc_id, tokens), a row a document. Stop-words (term) are taken out before lengths are counted; they come to
    the driver, since words in more than some share of the documents are at most the mean number of distinct words over
    that share. Texts are tokenised and counted in one pass without an exchange into a written table, a row a document,
    of whose columns all statistics follow; a posting carries its document's length, so that a query needs no other
    table of documents. Null tokens count in lengths only."""
    drop = [r["term"] for r in stopwords.select("term").collect()] if stopwords is not None else []
    given = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    kept = F.filter(given, lambda t: t.isNull() | ~t.isin(*drop)) if drop else given
    in_order, starts, counts = term_counts(F.col("t"))
    rows = docs.select("doc_id", kept.alias("t")).select("doc_id", F.size("t").cast("long").alias("dl"), in_order.alias("s")).select("doc_id", "dl", "s", starts("s").alias("at"))
    terms, tfs = counts("s", "at")
    counted = materialise(rows.select(F.monotonically_increasing_id().alias("at"), "doc_id", "dl", terms.alias("terms"), tfs.alias("tfs")), "term-counts", compression="zstd")
    # a document's postings lie together, so that its scores are summed where they lie
    postings = counted.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "doc_id", F.col("p.tfs").cast("long").alias("tf"), "dl")
    lengths = counted.select("doc_id", "dl")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return LexicalIndex(postings, df.join(F.broadcast(stats)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf")), lengths, stats, counted)  # stats: one row


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _best(scored: DataFrame, k: int, *tie: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_batch(index: LexicalIndex | StoredIndex, queries: DataFrame, k: int, positive: bool = True) -> DataFrame:
    """The k best documents of each query (query_id, terms): query_id, doc_id, score, rank. A term that a query repeats
    counts as often; ties go to the smaller doc_id. The ranking keeps k rows per query and task. With positive=False
    hits that score nothing stay. Of a stored index few queries read the blocks of their terms only (see there)."""
    if isinstance(index, StoredIndex):
        return _search_stored(index, queries, k, positive)
    asked = _asked(queries)
    weighed = asked.join(index.terms, "term").join(F.broadcast(index.stats)).select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "avgdl")
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hits = index.postings.join(F.broadcast(weighed) if few else weighed, "term")
    score = F.sum(F.col("weight") * saturated(F.col("tf"), F.col("dl"), F.col("avgdl")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(score, 9).alias("score"))  # ties do not depend on the order of a sum
    return _best(scored.where("score > 0") if positive else scored, k, "doc_id")


def _search_stored(index: StoredIndex, queries: DataFrame, k: int, positive: bool, least_slices: int = 64) -> DataFrame:
    """Up to IN_LIST_VALUES pairs of query and term are in the scan's filter; where the index has many slices, a pass over
    the blocks' bounds, without their arrays, leaves those slices out that cannot hold one of the k best. The k best, and
    what ties with the last of them, are known by their places; of few the ids are read from the documents' pages of
    their slices only. More pairs than that are scored in their slices."""
    spark, asked = queries.sparkSession, _asked(queries)
    some = asked.limit(PRUNED_TERMS + 1).collect()
    if len(some) > min(PRUNED_TERMS, IN_LIST_VALUES):
        few = len(some) <= PRUNED_TERMS or asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        return _named(index, _near(index.scored_in_slices(asked, few), k, positive), k)
    words = F.col("term").isin(sorted({r["term"] for r in some if r["term"] is not None}))
    few = F.broadcast(spark.createDataFrame(some, asked.schema).join(index.terms.where(words).select("term", "idf"), "term"))
    blocks = index.blocks.where(words).join(few, "term")
    if index.n > least_slices * index.slice_docs:
        kept = index.promising(blocks, k)
        blocks = blocks.join(kept, ["query_id", "slice"])
    near = _near(index.scored(blocks), k, positive)
    if k * len({r["query_id"] for r in some}) > PRUNED_TERMS or len(rows := near.limit(PRUNED_TERMS + 1).collect()) > PRUNED_TERMS:
        return _named(index, near, k)
    found = F.broadcast(spark.createDataFrame(rows, near.schema))
    return _named(index, found, k, F.col("slice").isin(sorted({r["slice"] for r in rows})))


def _near(scored: DataFrame, k: int, positive: bool) -> DataFrame:
    """The k best of each query and all that tie with the last of them."""
    scored = scored.where("score > 0") if positive else scored
    return scored.withColumn("n", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("n") <= k).drop("n")


def _named(index: StoredIndex, near: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The k best of what _near() gives, by the documents' ids."""
    docs = index.docs.select("slice", "place", "doc_id")
    return _best((docs if where is None else docs.where(where)).join(near, ["slice", "place"]), k, "doc_id").select("query_id", "doc_id", "score", "rank")


def metadata(docs: DataFrame, full: Column, tokens: str = "tokens", stopwords: int = 0) -> DataFrame:
    """One row about an index that is built from docs: documents, mean number of tokens (to 0.01), how many documents are
    there with their full content (full), and the number of stop-words."""
    mean = F.round(F.coalesce(F.avg(F.size(tokens)), F.lit(0.0)), 2)
    return docs.agg(F.count("*").alias("documents"), mean.alias("avg_tokens_per_doc"), F.count_if(F.coalesce(full, F.lit(False))).alias("full_content_docs")).withColumn("stopwords_count", F.lit(stopwords))


def scan_search(docs: DataFrame, terms: list[str], k: int, tokens: str = "tokens") -> DataFrame:
    """The k best documents for one query without an index: (doc_id, score). One pass over (doc_id, tokens) writes each
    document's length and how often it holds each term, a few numbers; statistics and scores are read from that."""
    few = lambda t: F.filter(F.col(tokens), lambda x: x.isin(*t))  # noqa: E731  few tokens are left to count
    times = lambda q: F.size(F.filter("hits", lambda x: x == q))
    found = docs.select("doc_id", F.size(tokens).alias("dl"), few(terms).alias("hits"))
    counted = materialise(found.select("doc_id", "dl", *[times(q).alias(f"tf{i}") for i, q in enumerate(terms)]), "term-counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score = sum((idf(F.col("n"), F.col(f"df{i}")) * saturated(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl")) for i in range(len(terms))), F.lit(0.0))
    return counted.join(F.broadcast(stats)).select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)
