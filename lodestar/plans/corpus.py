"""From a source tree to searchable tables, resumable by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extract, naming, text
from ..models import Embedder, Summariser, embed, summarise
from ..operators import graph, lexical, signals, vector
from ..sources.catalog import Paths
from ..sources.files import append_log, file_info, source_tree, write_analysis, write_contents, write_ranked
from ..storage import materialise
from . import phases


def analyse(spark: SparkSession, root: str, paths: Paths | None = None, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, edges): the record of every file, and its resolved calls. The tree is read once: records and calls are
    written tables, since what follows reads them several times."""
    info = materialise(file_info(source_tree(spark, root, max_files=max_files)), "records")
    files = info.withColumn("file_order", F.col("relative_path"))
    edges = materialise(graph.reference_edges(files), "calls")
    if paths is not None:
        nodes = info.select(F.col("relative_path").alias("node"))
        write_analysis(info, graph.reference_graph(nodes, edges), paths.analysis, root)
    return info, edges


def simplified(spark: SparkSession, root: str, max_files: int = 100) -> DataFrame:
    """Records of at most max_files files in path order, numbered, with the first qualified calls and without ranks or a
    graph: enough for a trial run. Few rows, so that one task numbers them."""
    c = F.col("content")
    tree = source_tree(spark, root, max_files=max_files)
    name = naming.api_key(F.concat(F.regexp_replace("file_name", r"\.plsql$", ""), F.lit("_API")))
    order = Window.orderBy("relative_path")
    return tree.select("file_path", "relative_path", "file_name", name.alias("api_name"), "file_size_mb", extract.qualified_calls(c).alias("api_calls"), extract.change_notes(c).alias("changelog_lines"), extract.declared_names(c).alias("procedure_function_names"), F.row_number().over(order).alias("rank"))


def rank(info: DataFrame, edges: DataFrame, **kw) -> DataFrame:
    """File records with pagerank_score and pagerank_rank."""
    scores = graph.pagerank(info.select(F.col("relative_path").alias("node")), edges, **kw)
    order = graph.ranked(scores, "score", name="pagerank_rank").select(F.col("node").alias("relative_path"), F.col("score").alias("pagerank_score"), "pagerank_rank")
    return info.join(order, "relative_path")


def rank_by_references(info: DataFrame, edges: DataFrame) -> DataFrame:
    """File records ranked by how many files call them."""
    counts = graph.in_degrees(info.select(F.col("relative_path").alias("node")), edges)
    order = graph.ranked(counts, "reference_count").select(F.col("node").alias("relative_path"), "reference_count", F.col("reference_count").alias("pagerank_score"), "rank")
    return info.join(order, "relative_path")


def tokens_of(content, stopwords: set[str] | None = None, stem: Callable | None = None):
    """Search tokens of cleaned source text."""
    cleaned = text.basic_tokens(text.clean_source(content))
    out = text.identifier_tokens(cleaned, stopwords if stopwords is not None else text.stopwords())
    return stem(out) if stem is not None else out


def lexical_index(tree: DataFrame, ranked: DataFrame, stem: Callable | None = None) -> lexical.LexicalIndex:
    """The index over the prepared text of every file; words of more than four files in five are stop-words."""
    described = tree.select("relative_path", "content").join(ranked.drop("file_path", "file_size_mb"), "relative_path")
    prepared = extract.lexical_text(tokens_of(F.col("content"), stem=stem), F.col("file_name"), F.col("api_name"), F.col("pagerank_rank"), F.col("changelog_lines"), F.col("procedure_function_names"))
    docs = described.select(F.col("relative_path").alias("doc_id"), F.transform(text.basic_tokens(prepared), F.lower).alias("tokens"))
    return lexical.build_index(docs, stopwords=lexical.corpus_stopwords(docs))


def summaries(tree: DataFrame, log: DataFrame | None, make: Callable[[], Summariser]) -> DataFrame:
    """Summaries of the files that no successful row of the log covers."""
    todo = tree.select(F.col("relative_path").alias("path"), "content")
    todo = phases.pending(todo, log) if log is not None else todo
    fitted = signals.within_context(todo, key="path")
    return summarise(fitted.select("path", "content"), "content", make).drop("content").withColumn("has_ai_summary", F.col("success"))


def embeddings(results: DataFrame, ranked: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """(vec_id, embedding), normalised, of all files with a summary."""
    rows = results.where("has_ai_summary").select(F.col("path").alias("relative_path"), "summary").join(ranked, "relative_path")
    what = extract.embedding_text(F.col("summary"), F.col("api_name"), F.col("file_name"), F.col("pagerank_rank"), F.col("api_calls"), F.col("procedure_function_names"))
    return vector.build(embed(rows.select(F.col("relative_path").alias("vec_id"), what.alias("_text")), "_text", make).drop("_text"))


def not_embedded(results: DataFrame, done: DataFrame | None) -> DataFrame:
    """The results (path) whose vectors (vec_id) an earlier run has not written."""
    return results if done is None else results.join(done.select(F.col("vec_id").alias("path")), "path", "left_anti")


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def build(spark: SparkSession, root: str, paths: Paths, embedder: Callable[[], Embedder], summariser: Callable[[], Summariser], document: bool = True) -> DataFrame:
    """All tables of a version: analysis, ranking, contents, lexical index, summaries, vectors; returns the phases'
    totals. What an earlier run has summarised or embedded successfully is not done again: results are appended to the
    checkpoints' logs, and only files that these do not cover are worked on. Remove the checkpoints and the vectors to
    begin anew. Without `document` the analysis document, which only other tools read, is not written."""
    tree = source_tree(spark, root)
    info, edges = analyse(spark, root, paths if document else None)
    ranked = rank(info, edges).cache()
    write_ranked(ranked.drop("content_hash"), paths.ranked)
    write_contents(tree, ranked, paths.contents)
    lexical_index(tree, ranked).write(paths.lexical)
    log = f"{paths.checkpoints}/summaries"
    append_log(summaries(tree, _saved(spark, log), summariser), log)
    results = phases.latest(spark.read.parquet(log), "path", "timestamp")
    embeddings(not_embedded(results, _saved(spark, paths.vectors)), ranked, embedder).write.mode("append").parquet(paths.vectors)
    ranked.unpersist()
    vectors = spark.read.parquet(paths.vectors).select(F.col("vec_id").alias("path"), "embedding")
    return phases.phase_totals(results.join(vectors, "path", "left"))
