"""Queries that run sources, sinks, plans and the search over a written tree of the composed files, with the equivalent
DuckDB SQL over the tables that the tree was made from.

The tree is made once per table folder and session: the composed files and some others go into a release archive, which
the import takes apart again."""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from dataclasses import asdict
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import models, queries, storage
from .functions import extract, naming, text, tokenize
from .operators import fusion, graph, lexical, signals, vector
from .plans import corpus, phases
from .plans.search import HybridSearch, SearchConfig
from .queries import _BM25, _BUDGET, _CUTS, _DESCRIBED, _DOT, _EDGES, _LINES_CTE, _ORDER, _SIGNALS, _TOKENS, FILES, FILES_CTE, QUERY_TERMS, _name, read, register, tokens
from .sources import catalog, files
from .sources.archive import write_archive
from .sources.catalog import Paths

VERSION = "24.2.1"


def made_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, as a plain path; release() deletes it."""
    place = urlparse(storage.scratch_path(spark, name))
    if place.scheme not in ("", "file"):
        raise ValueError("files are written below a mounted folder: spark.checkpoint.dir must be one")
    os.makedirs(place.path)
    return place.path


@storage.once
def _composed(spark: SparkSession, d: str) -> tuple[str, str]:
    """(data folder, archive) of the composed files."""
    data = made_folder(spark, "tree")
    archive = f"{data}/release.zip"
    others = {"checkout/fndbas/source/version.txt": f"# a comment\n\n// another\n{VERSION} build 7\n", "checkout/mod0/notes.txt": "no source", "other/mod0/Lost.plsql": "not below the root", "checkout/mod0/Page.CLIENT": "client x;"}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the keys are dealt, and files composed where they lie
    entry = read(spark, d, "part").repartition(parts, "p_partkey").select(*[F.expr(e).alias(n) for n, e in FILES.items()]).select(F.concat(F.lit("checkout/"), "relative_path").alias("entry"), F.col("content").cast("binary").alias("content"))
    write_archive(entry.unionByName(spark.createDataFrame([(k, v.encode()) for k, v in others.items()], "entry string, content binary")), archive)
    files.extract_archive(spark, archive, Paths.of(data, VERSION).source)
    return data, archive


def source(spark: SparkSession, d: str) -> DataFrame:
    return files.source_tree(spark, Paths.of(_composed(spark, d)[0], VERSION).source)


@storage.once
def _built(spark: SparkSession, d: str) -> Paths:
    """Analysis and reference ranking of the tree, written."""
    paths = Paths.of(_composed(spark, d)[0], VERSION)
    info, edges = corpus.analyse(spark, paths.source, paths)
    ranks = corpus.rank_by_references(info, edges).drop("content_hash", "reference_count").withColumnRenamed("rank", "pagerank_rank").withColumn("pagerank_score", F.col("pagerank_score").cast("double"))
    files.write_ranked(ranks, paths.ranked)
    return paths


_CALLS = "list_sort(list_distinct(list_transform(regexp_extract_all(content, '(?i)([A-Z][A-Z0-9_]*_API)\\.', 1), lambda x: upper(x))))"
_API = "concat({}, '_API')".format(_name("file_id", True))


# --- sources --------------------------------------------------------------------------------------------------------------


@register(FILES_CTE + " SELECT relative_path, file_name, sha256(content) AS hash, round(strlen(content) / 1048576.0, 9) AS file_size_mb FROM files")
def source_scan(spark, d):
    """Recursive scan, whole-file read, relative paths and sizes."""
    return source(spark, d).select("relative_path", "file_name", text.content_hash(F.col("content")).alias("hash"), F.round("file_size_mb", 9).alias("file_size_mb"))


@register(FILES_CTE + " SELECT relative_path FROM files ORDER BY relative_path LIMIT 25")
def source_scan_limited(spark, d):
    root = Paths.of(_composed(spark, d)[0], VERSION).source
    return files.source_tree(spark, root, max_files=25).select("relative_path")


@register(f"SELECT '{VERSION}' AS version")
def archive_version(spark, d):
    return spark.createDataFrame([(files.archive_version(_composed(spark, d)[1]),)], "version string")


@register(FILES_CTE + " SELECT relative_path, sha256(content) AS hash FROM files UNION ALL SELECT 'mod0/Page.CLIENT', sha256('client x;')")
def archive_sources(spark, d):
    """What an archive holds below its root, by suffix in any case."""
    found = files.archive_entries(spark, _composed(spark, d)[1], partition_bytes=64 << 10)
    return found.select("relative_path", F.sha2("content", 256).alias("hash"))


@register(f"SELECT '{VERSION}' AS version, '.plsql' AS extension, count(*) AS n FROM part")
def files_by_extension(spark, d):
    listing = files.file_listing(spark, f"{_composed(spark, d)[0]}/versions/{VERSION}/source")
    return files.count_by_extension(listing)


@register("SELECT unnest(['.entity', '.plsql', '.views', '.storage', '.fragment', '.projection', '.client']) AS suffix")
def suffix_domain(spark, d):
    return spark.createDataFrame([(s,) for s in files.SUFFIXES], "suffix string")


@register(f"SELECT unnest(['source', 'analysis', 'lexical', 'vectors', 'ranked.jsonl', 'checkpoints']) AS part, concat('versions/{VERSION}/', part) AS place")
def version_paths(spark, d):
    """Where the parts of a version lie; the name is made safe."""
    p = Paths.of("", f"{VERSION[:2]}/{VERSION[2:]}")
    parts = {"source": p.source, "analysis": p.analysis, "lexical": p.lexical, "vectors": p.vectors, "ranked.jsonl": p.ranked, "checkpoints": p.checkpoints}
    return spark.createDataFrame([(k, v.lstrip("/")) for k, v in parts.items()], "part string, place string")


@register("SELECT 'release/checkout' AS found")
def work_folder(spark, d):
    """Single folders are descended until one holds both markers."""
    top = made_folder(spark, "call")
    for marker in ("fndbas", "order"):
        os.makedirs(f"{top}/release/checkout/{marker}")
    return spark.createDataFrame([(os.path.relpath(catalog.work_root(top), top),)], "found string")


# --- analysis -------------------------------------------------------------------------------------------------------------


@register(FILES_CTE + f" SELECT relative_path, file_name, {_API} AS api_name, array_to_string({_CALLS}, ',') AS api_calls, round(strlen(content) / 1048576.0, 9) AS file_size_mb FROM files")
def analysis_document(spark, d):
    """File records written as one JSON document and read again."""
    rows = files.read_analysis(spark, _built(spark, d).analysis)
    return rows.select("relative_path", "file_name", "api_name", F.array_join("api_calls", ",").alias("api_calls"), F.round("file_size_mb", 9).alias("file_size_mb"))


@register(FILES_CTE + f" SELECT count(*) AS total_files_found, count(*) AS total_files_processed, sum(len({_CALLS}))::BIGINT AS total_api_calls_found FROM files")
def analysis_stats(spark, d):
    return files.global_stats(files.file_info(source(spark, d)))


@register(FILES_CTE + f" SELECT relative_path, {_API} AS api_name, sha256(content) AS content_hash, len({_CALLS})::INT AS n_calls FROM files")
def file_records(spark, d):
    return files.file_info(source(spark, d)).select("relative_path", "api_name", "content_hash", F.size("api_calls").alias("n_calls"))


_FILE_EDGES = _DESCRIBED.replace("arg_max(relative_path, file_id)", "max(relative_path)") + ", e AS (SELECT DISTINCT f.relative_path AS src, dst FROM x JOIN files f USING (file_id) JOIN dim USING (api_key) WHERE f.relative_path <> dst), c AS (SELECT relative_path, count(src) AS n FROM files LEFT JOIN e ON dst = relative_path GROUP BY 1)"


@register(_FILE_EDGES + ", l AS (SELECT f.relative_path, list_sort(list_distinct(list(e.dst) FILTER (e.dst IS NOT NULL))) AS t FROM files f LEFT JOIN e ON e.src = f.relative_path GROUP BY 1) SELECT relative_path AS src, coalesce(array_to_string(t, ','), '') AS targets FROM l")
def reference_graph_of_tree(spark, d):
    info = storage.materialise(files.file_info(source(spark, d)).select("relative_path", "api_name", "api_calls"), "records").withColumn("file_order", F.col("relative_path"))
    found = graph.reference_graph(info.select(F.col("relative_path").alias("node")), graph.reference_edges(info))
    return found.select("src", F.array_join("targets", ",").alias("targets"))


@register(_FILE_EDGES + ", l AS (SELECT f.relative_path, list_sort(list_distinct(list(e.dst) FILTER (e.dst IS NOT NULL))) AS t FROM files f LEFT JOIN e ON e.src = f.relative_path GROUP BY 1), o AS (SELECT relative_path, row_number() OVER (ORDER BY relative_path)::INT - 1 AS file_order FROM files) SELECT relative_path AS src, file_order, coalesce(array_to_string(t, ','), '') AS targets FROM l JOIN o USING (relative_path)")
def analysis_links(spark, d):
    """The reference graph and the records' order, from the written document after its parts have been joined into one
    file, which is read line by line."""
    target = f"{_built(spark, d).base}/analysis-{uuid.uuid4().hex}.json"
    files.single_file(spark, _built(spark, d).analysis, target)
    order = files.read_analysis(spark, target).select(F.col("relative_path").alias("src"), "file_order")
    return files.read_links(spark, target).join(order, "src").select("src", "file_order", F.array_join("targets", ",").alias("targets"))


@register(_FILE_EDGES + " SELECT relative_path, n::DOUBLE AS pagerank_score, row_number() OVER (ORDER BY n DESC, relative_path)::INT AS pagerank_rank FROM c")
def ranked_lines(spark, d):
    """Full analysis with reference ranks, written as JSON lines in rank order and read again."""
    return files.read_ranked(spark, _built(spark, d).ranked).select("relative_path", "pagerank_score", "pagerank_rank")


@register(_FILE_EDGES + ", m AS (SELECT max(n) AS best, min(n) AS least FROM c) SELECT relative_path, row_number() OVER (ORDER BY n DESC, relative_path)::INT AS rank FROM c ORDER BY n DESC, relative_path LIMIT 10")
def top_ranked(spark, d):
    rows = files.read_ranked(spark, _built(spark, d).ranked)
    return rows.orderBy("pagerank_rank").limit(10).select("relative_path", F.col("pagerank_rank").alias("rank"))


@register(FILES_CTE + f" SELECT file_name, len({_CALLS})::INT AS calls FROM files ORDER BY 2 DESC, relative_path LIMIT 10")
def top_by_calls(spark, d):
    return graph.top_by_calls(files.file_info(source(spark, d)))


@register(FILES_CTE + f", r AS (SELECT *, row_number() OVER (ORDER BY relative_path)::INT AS rank FROM files) SELECT rank, relative_path, upper(regexp_replace(regexp_replace(file_name, '\\.plsql$', ''), '([a-z_])([A-Z])', '\\1_\\2', 'g')) || '_API' AS api_name, len(regexp_extract_all(content, '\\b([A-Z][A-Za-z_]*_API)\\.([A-Za-z_]+)\\s*\\('))::INT AS n_calls FROM r WHERE rank <= 100")
def simplified_list(spark, d):
    root = Paths.of(_composed(spark, d)[0], VERSION).source
    return corpus.simplified(spark, root).select("rank", "relative_path", "api_name", F.size("api_calls").alias("n_calls"))


@register(FILES_CTE + " SELECT file_id, upper(regexp_replace(regexp_replace(file_name, '\\.plsql$', ''), '([a-z_])([A-Z])', '\\1_\\2', 'g')) || '_API' AS api_key FROM files")
def engine_naming(spark, d):
    name = F.concat(F.regexp_replace("file_name", r"\.plsql$", ""), F.lit("_API"))
    return queries.files(spark, d).select("file_id", naming.api_key(name).alias("api_key"))


# --- texts that are built from a record -------------------------------------------------------------------------------------


@register(
    _SIGNALS
    + f""", g AS (SELECT file_id, signal, string_agg(line, chr(10) ORDER BY pos) AS t, {_CUTS} AS m FROM sig WHERE signal IS NOT NULL GROUP BY file_id, signal),
    x AS (SELECT *, left(t, m) AS cut, length(left(t, m)) - instr(reverse(left(t, m)), chr(10)) AS last FROM g),
    y AS (SELECT file_id, signal, CASE WHEN length(t) > m THEN CASE WHEN contains(cut, chr(10)) AND last > m * 0.8 THEN left(cut, last) ELSE cut END ELSE t END AS t FROM x),
    b AS (SELECT file_id, string_agg(chr(10) || '--- ' || upper(replace(signal, '_', ' ')) || ' ---' || chr(10) || t, chr(10) ORDER BY {_ORDER}) AS t FROM y WHERE trim(t) <> '' GROUP BY file_id)
    SELECT file_id, CASE WHEN length(content) // 4 <= {_BUDGET + 100} THEN content ELSE b.t END AS content FROM files JOIN b USING (file_id)"""
)
def truncated_to_context(spark, d):
    """Short files whole, signals of the long ones."""
    return signals.within_context(queries.files(spark, d), limit=_BUDGET + 100, reserve=100).select("file_id", "content")


def _records(spark, d) -> DataFrame:
    c = F.col("content")
    name = naming.api_name(naming.base_name(F.col("file_name")))
    return queries.files(spark, d).select("file_id", "file_name", "content", name.alias("api_name"), F.col("file_id").cast("int").alias("rank"), extract.api_calls(c).alias("api_calls"), extract.declared_names(c).alias("names"), extract.change_notes(c).alias("notes"))


_RECORDS = FILES_CTE + f", r AS (SELECT file_id, file_name, content, {_API} AS api_name, {_CALLS} AS api_calls FROM files)"


@register(_RECORDS + " SELECT file_id, 'Business Function: stands for ' || file_name || ' | Component: ' || api_name || ' in ' || file_name || ' | Domain: ' || replace(replace(api_name, '_API', ''), '_', ' ') || ' | System Importance: Rank ' || file_id || ' of 9750 | Dependencies: ' || len(api_calls) || ' API calls including ' || CASE WHEN len(api_calls) > 0 THEN array_to_string(api_calls[1:5], ', ') ELSE 'none' END AS described FROM r")
def embedding_texts(spark, d):
    r = _records(spark, d)
    made = extract.embedding_text(F.concat(F.lit("stands for "), "file_name"), F.col("api_name"), F.col("file_name"), F.col("rank"), F.col("api_calls"), F.col("names"))
    return r.select("file_id", F.regexp_extract(made, r"^(.*) \| Implementation: [0-9]+ key procedures/functions$", 1).alias("described"))


@register(_RECORDS + " SELECT file_id, 'filename:' || lower(file_name) || ' apiname:' || lower(api_name) || ' rank:' || file_id || CASE WHEN len(api_calls) > 0 THEN ' ' || array_to_string(api_calls, ' ') || ' procedures:' || lower(array_to_string(api_calls, ' ')) ELSE '' END AS prepared FROM r")
def lexical_texts(spark, d):
    none = F.array().cast("array<string>")
    made = extract.lexical_text(F.col("api_calls"), F.col("file_name"), F.col("api_name"), F.col("rank"), none, F.col("api_calls"))
    return _records(spark, d).select("file_id", made.alias("prepared"))


@register(_RECORDS + " SELECT file_id, sha256('Summarise this source file for semantic search.' || chr(10) || 'File: ' || file_name || chr(10) || 'API: ' || api_name || chr(10) || 'Importance rank: ' || file_id || chr(10) || 'External calls: ' || len(api_calls) || CASE WHEN len(api_calls) > 0 THEN chr(10) || chr(10) || 'Declared procedures and functions:' || chr(10) || array_to_string(api_calls, chr(10)) ELSE '' END || chr(10) || chr(10) || 'Signals:' || chr(10) || content || chr(10) || chr(10) || 'State its business purpose, main operations, error cases, the data it manages and the files it works with.') AS prompt FROM r")
def summary_prompts(spark, d):
    none = F.array().cast("array<string>")
    made = extract.summary_prompt(F.col("content"), F.col("file_name"), F.col("api_name"), F.col("rank"), F.col("api_calls"), none, F.col("api_calls"))
    return _records(spark, d).select("file_id", F.sha2(made, 256).alias("prompt"))


@register(_RECORDS + " SELECT file_id, CASE WHEN file_id % 3 = 0 THEN '' ELSE 'API: ' || api_name || '. ' END || api_name || ' - ' || file_name || '. no text' AS passage FROM r")
def rerank_passages(spark, d):
    """A reranker's passage and a result's title; the API is told where there is one."""
    title = F.concat_ws(" - ", "api_name", "file_name")
    api = F.when(F.col("file_id") % 3 != 0, F.col("api_name"))
    return _records(spark, d).select("file_id", fusion.passage(api, title, F.lit("no text")).alias("passage"))


@register(FILES_CTE + " SELECT file_id, 'source/' || replace(relative_path, '/', '|') AS path FROM files")
def resolved_paths(spark, d):
    given = F.concat(F.lit("_work\\"), F.replace("relative_path", F.lit("/"), F.lit("|")))
    return queries.files(spark, d).select("file_id", text.resolve_path(given).alias("path"))


@register(
    """SELECT doc_id, concat_ws(' • ', CASE doc_id % 3 WHEN 0 THEN 'Exact match found in source code' WHEN 1 THEN 'Semantic similarity to your query' ELSE 'Found through both exact and semantic matching' END,
    CASE doc_id % 4 WHEN 0 THEN 'Matched through lexical search' WHEN 1 THEN 'Matched through embedding similarity' WHEN 2 THEN 'Reranked for relevance' END,
    CASE WHEN n_chars % 40 <= 10 THEN 'High importance file (rank #' || (n_chars % 40) || ')' END) AS explanation FROM documents"""
)
def explanations(spark, d):
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % n + 1).cast("int"))
    hits = read(spark, d, "documents").select("doc_id", pick(3, "exact", "semantic", "mixed").alias("match_type"), pick(4, "lexical", "vector", "vector+reranked", "hybrid").alias("source"), (F.col("n_chars") % 40).alias("rank"))
    return fusion.explained(hits).select("doc_id", "explanation")


#: Words with the stems that the published algorithm gives them.
_STEMS = {"consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol", "knightly": "knight", "knots": "knot", "skies": "sky", "dying": "die", "generate": "generat", "generously": "generous", "hopping": "hop", "hoped": "hope", "agreed": "agre", "falling": "fall", "cry": "cri", "by": "by", "say": "say", "national": "nation", "relational": "relat", "hopefulness": "hope", "troubled": "troubl", "sized": "size", "ties": "tie", "gas": "gas", "gaps": "gap", "proceed": "proceed"}


@register("SELECT unnest([" + ", ".join(f"'{w}'" for w in _STEMS) + "]) AS word, unnest([" + ", ".join(f"'{s}'" for s in _STEMS.values()) + "]) AS stem")
def stemmed_words(spark, d):
    rows = spark.createDataFrame([(w,) for w in _STEMS], "word string")
    return rows.select("word", F.element_at(tokenize.stemmed(F.array("word")), 1).alias("stem"))


@register(f"WITH {_TOKENS}, e AS (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM t), c AS (SELECT term FROM e WHERE length(term) > 2 AND term NOT IN ({', '.join(repr(w) for w in text.LANGUAGE_KEYWORDS)}) GROUP BY term HAVING count(*) > 0.2 * (SELECT count(*) FROM documents)) SELECT term FROM c UNION SELECT unnest([" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({*text.ENGLISH_STOPWORDS, *text.PROGRAMMING_STOPWORDS, *text.NOISE_TOKENS})) + "])")
def stopword_union(spark, d):
    """The fixed stop-words with those of the corpus."""
    found = [r["term"] for r in lexical.corpus_stopwords(tokens(spark, d), share=0.2).collect()]
    return spark.createDataFrame([(w,) for w in sorted(text.stopwords(corpus=found))], "term string")


# --- indexes, written and read ------------------------------------------------------------------------------------------------


@storage.once
def _index(spark, d, kind: str = "long") -> lexical.StoredIndex:
    """The index of the documents, written once per session and read as tables. kind: of the documents' ids, in whose
    order they are numbered."""
    return lexical.LexicalIndex.read(spark, _index_path(spark, d, kind))


@storage.once
def _index_path(spark, d, kind: str) -> str:
    path = storage.scratch_path(spark, "index")
    lexical.build_index(tokens(spark, d).withColumn("doc_id", F.col("doc_id").cast(kind))).write(path, buckets=8)
    return path


@register(
    f"""WITH {_TOKENS}, q AS (SELECT item_id AS query_id, unnest(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))) AS term FROM benchmark),
    qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
    e AS (SELECT doc_id, unnest(tokens) AS term FROM t), p AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
    r AS (SELECT query_id, p.doc_id, round(sum(times * {_BM25}), 9) AS score FROM qt JOIN p USING (term) JOIN f USING (term) JOIN (SELECT doc_id, len(tokens) AS dl FROM t) USING (doc_id), s GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r)
    SELECT query_id, rank, doc_id, round(score, 5) AS score FROM k WHERE rank <= 2"""
)
def stored_index_search(spark, d):
    """The benchmark's items as queries of the stored index, hits without a positive score included."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.transform(text.basic_tokens(F.col("text")), F.lower).alias("terms"))
    return lexical.search_batch(_index(spark, d), asked, 2, positive=False).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 5).alias("score"))


@register(f"WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt({_DOT.replace('a.embedding', 'embedding').replace('b.embedding', 'embedding')})) AS embedding FROM embeddings) SELECT a.vec_id, round({_DOT}, 6) AS score, lang FROM n a JOIN documents ON doc_id = a.vec_id, n b WHERE b.vec_id = 3 AND a.vec_id <> 3 ORDER BY {_DOT} DESC, a.vec_id LIMIT 15")
def stored_vector_search(spark, d):
    """Vectors written normalised, read, searched, and joined to what the documents say about them."""
    path = storage.scratch_path(spark, "vectors")
    vector.build(read(spark, d, "embeddings")).write.parquet(path)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    stored = spark.read.parquet(path).join(docs.select("vec_id"), "vec_id", "left_semi")
    return vector.search_like(stored, 3, 15).join(docs, "vec_id").select("vec_id", F.round("score", 6).alias("score"), "lang")


#: What the search queries ask; the document rank and boost are made from its length.
ASKED = " ".join(QUERY_TERMS)


class _Fixed:
    """STAND-IN: an embedder that answers every query with one stored vector."""

    def __init__(self, v: list[float]) -> None:
        self.v = v

    def __call__(self):
        return lambda texts: np.array([self.v] * len(texts))


def _engine(spark, d, vectors: bool) -> HybridSearch:
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat("source", F.lit(".txt")).alias("file_name"), F.col("lang").alias("api_name"), (F.col("n_chars") % 40).cast("int").alias("rank"), F.col("text").alias("content"))
    ranks = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.lit(None).cast("string").alias("file_path"), (F.col("n_chars") / 20000).alias("pagerank_score"))
    index = _index(spark, d, "string")
    found = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("vec_id"), "embedding").join(docs.select(F.col("path").alias("vec_id")), "vec_id", "left_semi")
    own = found.where("vec_id = '7'").first() if vectors else None
    return HybridSearch(docs, index, found if vectors else None, ranks, _Fixed(own["embedding"]) if vectors else None, None, tokens=lambda c: F.transform(text.basic_tokens(c), F.lower))


_LEX = f"""{_TOKENS}, q AS (SELECT unnest({QUERY_TERMS}) AS term), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
    p AS (SELECT doc_id, len(tokens) AS dl, term, len(list_filter(tokens, lambda x: x = term)) AS tf FROM t, q), f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM p GROUP BY term),
    lex AS (SELECT doc_id::VARCHAR AS path, round(sum({_BM25}), 9) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id HAVING round(sum({_BM25}), 9) > 0 ORDER BY 2 DESC, 1 LIMIT 20)"""
_BOOSTED = "(SELECT path, score * (1 + least(1, greatest(0, n_chars / 20000))) AS score FROM {} JOIN documents ON doc_id::VARCHAR = path ORDER BY 2 DESC, 1 LIMIT {})"
_SNIPPET = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    sn AS (SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line, len(list_filter({QUERY_TERMS}, lambda w: contains(lower(line), w))) AS sc FROM l),
    bl AS (SELECT doc_id, arg_max(line, sc * 1000000 - pos) AS line FROM sn WHERE sc > 0 AND length(line) > 10 GROUP BY doc_id)"""
_SHOWN = "concat_ws(' - ', lang, source || '.txt') AS title, coalesce(CASE WHEN length(line) > 200 THEN left(line, 200) || '...' ELSE line END, 'No preview available') AS snippet"
_HIGH = "CASE WHEN n_chars % 40 <= 10 THEN 'High importance file (rank #' || (n_chars % 40) || ')' END"


@register(f"WITH {_LEX}, {_SNIPPET}, b AS {_BOOSTED.format('lex', 10)} SELECT path, round(score, 6) AS score, {_SHOWN}, concat_ws(' • ', 'Exact match found in source code', 'Matched through lexical search', {_HIGH}) AS explanation FROM b JOIN documents ON doc_id::VARCHAR = path LEFT JOIN bl USING (doc_id)")
def lexical_search(spark, d):
    """The search with its lexical side only: hits, documents, snippets, titles, boost, cut, explanations."""
    config = SearchConfig("lexical", enable_vectors=False, enable_rerank=False, fetch_multiplier=2)
    return _engine(spark, d, False).search(ASKED, top_k=10, config=config).results.select("path", F.round("score", 6).alias("score"), "title", "snippet", "explanation")


@register(
    f"""WITH {_LEX}, {_SNIPPET}, vec AS (SELECT a.vec_id::VARCHAR AS path, {_DOT} AS score FROM embeddings a JOIN documents ON doc_id = a.vec_id, embeddings b WHERE b.vec_id = 7 AND {_DOT} > 0 ORDER BY 2 DESC, 1 LIMIT 20),
    a AS {_BOOSTED.format('lex', 5)}, b AS {_BOOSTED.format('vec', 5)},
    m AS (SELECT path, CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN (a.score + b.score) / 2 ELSE coalesce(a.score, b.score) END AS score, CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN 'hybrid' WHEN a.score IS NOT NULL THEN 'lexical' ELSE 'vector' END AS source FROM a FULL JOIN b USING (path))
    SELECT path, round(score, 6) AS score, m.source, {_SHOWN.replace("source ||", "documents.source ||")}, concat_ws(' • ', CASE m.source WHEN 'lexical' THEN 'Exact match found in source code' WHEN 'vector' THEN 'Semantic similarity to your query' ELSE 'Found through both exact and semantic matching' END, CASE m.source WHEN 'lexical' THEN 'Matched through lexical search' WHEN 'vector' THEN 'Matched through embedding similarity' END, {_HIGH}) AS explanation
    FROM m JOIN documents ON doc_id::VARCHAR = path LEFT JOIN bl USING (doc_id) WHERE score >= 0.5"""
)
def hybrid_search(spark, d):
    """The whole search but for the reranker: both sides, boosts, quotas, merge, cut, threshold, explanations."""
    config = SearchConfig("medium", enable_vectors=True, enable_rerank=False, fetch_multiplier=2, min_score_threshold=0.5)
    return _engine(spark, d, True).search(ASKED, top_k=10, config=config).results.select("path", F.round("score", 6).alias("score"), "source", "title", "snippet", "explanation")


@register(f"WITH {_LEX}, b AS {_BOOSTED.format('lex', 10)} SELECT row_number() OVER (ORDER BY score DESC, path)::INT AS place, path FROM b")
def search_tool(spark, d):
    """The search tool's Markdown: the paths that it lists, in order."""
    from .tools import search_lexical

    import re

    found = re.findall(r"- path: `(.*)`", search_lexical(_engine(spark, d, False), ASKED))
    return spark.createDataFrame(list(enumerate(found, 1)), "place int, path string")


@register("SELECT (SELECT count(*) FROM documents) AS lexical_documents, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) AS vectors, FALSE AS initialised")
def engine_stats(spark, d):
    found = _engine(spark, d, True).stats()
    return spark.createDataFrame([Row(*[found[k] for k in ("lexical_documents", "vectors", "initialised")])], "lexical_documents long, vectors long, initialised boolean")


@register(
    """WITH """ + _LEX.replace("doc_id::VARCHAR AS path", "doc_id AS path") + f""", w AS (SELECT path, list_distinct(regexp_split_to_array(lower(text), '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}\\x{{0b}}]+')) AS words FROM lex JOIN documents ON doc_id = path)
    SELECT path, round(len(list_filter({QUERY_TERMS}, lambda x: list_contains(words, x))) / 4.0, 6)::DOUBLE AS score, 'lexical+reranked' AS source FROM w"""
)
def reranked(spark, d):
    """The stored index's 20 best documents, rescored by a stand-in reranker that reads their whole texts."""
    asked = spark.createDataFrame([(0, QUERY_TERMS)], "query_id int, terms array<string>")
    hits = lexical.search_batch(_index(spark, d), asked, 20).select(F.col("doc_id").alias("path"), "score", F.lit("lexical").alias("source")).collect()
    passages = read(spark, d, "documents").where(F.col("doc_id").isin(*[r["path"] for r in hits])).select(F.col("doc_id").alias("path"), F.col("text").alias("passage"))
    few = passages.join(F.broadcast(spark.createDataFrame(hits, "path long, score double, source string")), "path")  # 20 rows
    return models.rerank(few, ASKED, "passage", models.overlap_reranker).select("path", F.round("score", 6).alias("score"), "source")


@register(
    f"""WITH RECURSIVE {_EDGES.replace("e AS", "e AS MATERIALIZED")}, n AS (SELECT count(*) AS n FROM part), o AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e),
    r AS (SELECT 0 AS step, p_partkey AS node, 1.0::DOUBLE / n AS score, 2.0::DOUBLE AS old FROM part, n UNION ALL
      (WITH cur AS (SELECT * FROM r), flow AS (SELECT dst, sum(score * share) AS f FROM o JOIN cur ON node = src GROUP BY dst), moved AS (SELECT sum(abs(score - old)) AS m, max(step) AS s FROM cur)
      SELECT step + 1, cur.node, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(f, 0), cur.score FROM cur LEFT JOIN flow ON dst = cur.node, n, moved WHERE m >= 1e-6 AND s < 100)),
    z AS (SELECT node, round(score, 9) AS score FROM r WHERE step = (SELECT max(step) FROM r))
    SELECT node, score, row_number() OVER (ORDER BY score DESC, node)::INT AS rank FROM z"""
)
def pagerank_until_converged(spark, d):
    """PageRank over all calls until the scores move by less than 1e-6 in sum, and the ranks."""
    scores = graph.pagerank(queries.part_nodes(spark, d), queries.call_edges(spark, d)).select("node", F.round("score", 9).alias("score"))
    return graph.ranked(scores, "score")


_STRAY = _EDGES + ", k AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 10 <> 0), x AS (SELECT * FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)), o AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM x), n AS (SELECT count(*) AS n FROM k), r0 AS (SELECT node, 1.0::DOUBLE / n AS score FROM k, n)" + "".join(f", r{i} AS (SELECT k.node, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * coalesce(sum(score * share), 0) AS score FROM k CROSS JOIN n LEFT JOIN o ON dst = k.node LEFT JOIN r{i - 1} ON r{i - 1}.node = src GROUP BY k.node)" for i in (1, 2))


@register(f"WITH {_STRAY} SELECT node, round(score, 9) AS score FROM r2")
def pagerank_of_known_nodes(spark, d):
    """Two steps where a tenth of the parts are no nodes: calls from and to those do not count, over the whole table."""
    nodes = queries.part_nodes(spark, d).where("node % 10 <> 0")
    return graph.pagerank(nodes, queries.call_edges(spark, d), iterations=2, tolerance=None).select("node", F.round("score", 9).alias("score"))


# --- table functions, by SQL text ---------------------------------------------------------------------------------------------

_WORDS_OF = "list_distinct(regexp_split_to_array(lower(text), '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}\\x{0b}]+'))"


def _by_sql(spark, d, sql: str) -> DataFrame:
    """SQL over the tables with the library's table functions."""
    from .functions import tables

    tables.register(spark)
    return spark.sql(sql, docs=read(spark, d, "documents"))


@register(f"SELECT lang AS query_id, doc_id::VARCHAR AS key, round(score, 6)::DOUBLE AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id::VARCHAR)::INT AS place FROM (SELECT lang, doc_id, len(list_filter({QUERY_TERMS}, lambda x: list_contains({_WORDS_OF}, x))) / 4.0 AS score FROM documents)) WHERE place <= 7")
def reranked_by_sql(spark, d):
    """The seven best documents of each language for a query, by a reranker that SQL calls for a partition a language."""
    table = f"SELECT lang AS query_id, '{ASKED}' AS query, doc_id AS key, text AS passage FROM {{docs}}"
    return _by_sql(spark, d, f"SELECT query_id, key, round(score, 6) AS score, place FROM lodestar_rerank(t => TABLE({table}) PARTITION BY query_id, k => 7)")


@register("WITH e AS (SELECT lang, doc_id, unnest(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x))) AS token FROM documents) SELECT lang, token, count(*) AS n, count(DISTINCT doc_id) AS df FROM e GROUP BY ALL HAVING count(*) >= 5")
def tokens_by_sql(spark, d):
    """Frequencies of the words of each language, tokenised in SQL and counted there."""
    found = "lodestar_tokens(TABLE(SELECT doc_id AS key, text FROM {docs}))"
    return _by_sql(spark, d, f"SELECT lang, token, count(*) AS n, count(DISTINCT key) AS df FROM {found} JOIN {{docs}} ON key = CAST(doc_id AS STRING) GROUP BY lang, token HAVING count(*) >= 5")


@register("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), s AS (SELECT doc_id, pos, regexp_replace(line, '^[\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}]+|[\\s\\p{Z}\\x{0b}\\x{1c}-\\x{1f}\\x{85}]+$', '', 'g') AS line FROM l), f AS (SELECT doc_id, arg_min(line, pos) AS line FROM s WHERE line <> '' GROUP BY doc_id) SELECT d.doc_id::VARCHAR AS key, coalesce(line, '') AS summary, NULL::VARCHAR AS error FROM documents d LEFT JOIN f USING (doc_id)")
def summaries_by_sql(spark, d):
    return _by_sql(spark, d, "SELECT key, summary, error FROM lodestar_summarise(TABLE(SELECT doc_id AS key, text FROM {docs}))")


# --- phases, progress, versions ---------------------------------------------------------------------------------------------


def _results(spark, d) -> DataFrame:
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("path"), (F.col("quality") == 1).alias("has_ai_summary"))
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("path"), "embedding")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("path"), (F.col("n_chars") > 100).alias("success"), F.when(F.col("lang") != "de", F.col("lang")).alias("summary"), F.when(F.col("lang") != "fr", F.lit("")).otherwise("x").alias("content_excerpt"))
    return docs.join(labels, "path", "left").join(vectors, "path", "left").withColumn("has_ai_summary", F.coalesce("has_ai_summary", F.lit(False)))


_RESULTS = "WITH r AS (SELECT d.doc_id AS path, n_chars > 100 AS success, CASE WHEN lang <> 'de' THEN lang END AS summary, CASE WHEN lang <> 'fr' THEN '' ELSE 'x' END AS content_excerpt, coalesce(quality = 1, FALSE) AS has_ai_summary, embedding FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings ON vec_id = d.doc_id)"


@register(_RESULTS + " SELECT path, 'summary' AS need FROM r WHERE success AND NOT has_ai_summary UNION ALL SELECT path, 'embedding' FROM r WHERE has_ai_summary AND embedding IS NULL")
def pending_phases(spark, d):
    r = _results(spark, d)
    return phases.needs_summary(r).select("path", F.lit("summary").alias("need")).unionByName(phases.needs_embedding(r).select("path", F.lit("embedding").alias("need")))


@register(_RESULTS + " SELECT path FROM r WHERE success AND coalesce(nullif(summary, ''), nullif(content_excerpt, '')) IS NOT NULL")
def indexable_results(spark, d):
    return phases.indexable(_results(spark, d)).select("path")


@register(_RESULTS + ", n AS (SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (has_ai_summary) AS summarised, count(*) FILTER (embedding IS NOT NULL) AS embedded FROM r) SELECT *, successful / greatest(1, total)::DOUBLE AS success_rate, summarised / greatest(1, successful)::DOUBLE AS summary_rate, embedded / greatest(1, summarised)::DOUBLE AS embedding_rate FROM n")
def phase_totals(spark, d):
    return phases.phase_totals(_results(spark, d))


@register("SELECT count(*) AS files_processed, count(*) FILTER (event_type <> 'error') AS files_successful, min(ts) AS start_time, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1000000.0), 6) AS current_rate, date_trunc('second', max(ts) + to_microseconds((count(*) / (count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1000000.0)) * 1000000)::BIGINT)) AS estimated_completion FROM events")
def saved_progress(spark, d):
    """Progress of one run half way through, saved, loaded, with its estimated end."""
    log = read(spark, d, "events").select(F.lit("run").alias("run"), F.col("ts").alias("timestamp"), (F.col("event_type") != "error").alias("success"))
    path = storage.scratch_path(spark, "progress")
    phases.save_progress(phases.progress(log, total=2 * log.count()), path)
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    end = F.date_trunc("second", "estimated_completion").cast("timestamp_ntz").alias("estimated_completion")
    return phases.load_progress(spark, path).select("files_processed", "files_successful", plain("start_time"), F.round("current_rate", 6).alias("current_rate"), end)


@register("SELECT * FROM (VALUES ('model', 'stand-in'), ('total', '3')) v(key, value)")
def run_metadata(spark, d):
    path = storage.scratch_path(spark, "meta")
    phases.save_metadata(spark, {"model": "old"}, path)
    phases.save_metadata(spark, {"model": "stand-in", "total": "3"}, path)
    return spark.read.parquet(path).where("saved_at is not null").select("key", "value")


@register("SELECT doc_id AS path FROM documents")
def archived_checkpoints(spark, d):
    """A log under a stamped name; nothing is left under the old one."""
    path = storage.scratch_path(spark, "log")
    files.append_log(read(spark, d, "documents").select(F.col("doc_id").alias("path")), path)
    moved = phases.archive(spark, path, "20240101")
    assert phases.archive(spark, path, "20240102") is None
    return spark.read.parquet(moved).where("timestamp is not null").select("path")


@register("SELECT path, last AS summary FROM (SELECT user_id AS path, arg_max(event_type, event_id) AS last FROM events GROUP BY 1)")
def appended_log(spark, d):
    """A checkpoint log that several appends have made; the last row of each path counts."""
    path = storage.scratch_path(spark, "log")
    events = read(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("summary"), F.col("event_id").alias("seq"))
    for third in range(3):  # whole table, in three appends
        files.append_log(events.where(F.col("seq") % 3 == third), path)
    return phases.latest(spark.read.parquet(path).drop("timestamp"))


@register(f"SELECT '{VERSION}' AS version, count(*)::INT AS file_count, TRUE AS has_analysis, TRUE AS has_pagerank, FALSE AS has_lexical, FALSE AS is_ready FROM part")
def version_listing(spark, d):
    _built(spark, d)
    return catalog.version_table(spark, _composed(spark, d)[0]).select("version", "file_count", "has_analysis", "has_pagerank", "has_lexical", "is_ready")


@register("SELECT 'kept' AS version")
def deleted_version(spark, d):
    data = made_folder(spark, "call")
    for v in ("kept", "gone"):
        os.makedirs(Paths.of(data, v).source)
    assert not catalog.delete_version(data, "gone") and catalog.delete_version(data, "gone", confirmed=True)
    out = spark.createDataFrame([(asdict(s)["version"],) for s in catalog.versions(data)], "version string")
    shutil.rmtree(data)
    return out


_LISTED = "SELECT 'versions/v/' || CASE p_partkey % 5 WHEN 0 THEN 'vectors/part-' WHEN 1 THEN 'lexical/postings/part-' WHEN 2 THEN 'source/lexicals-' WHEN 3 THEN 'lexical/stats/part-' ELSE 'analysis/part-' END || p_partkey AS path FROM part UNION ALL SELECT 'versions/v/ranked.jsonl/part-0'"


@register(f"WITH l AS ({_LISTED}) SELECT path, CASE WHEN path LIKE '%/vectors/%' THEN 'vector table' WHEN path LIKE '%/lexical/%' THEN 'lexical index, ' || split_part(path, '/', 4) ELSE 'file ranking' END AS description FROM l WHERE path LIKE '%/vectors/%' OR path LIKE '%/lexical/%' OR path LIKE '%/ranked.jsonl/%'")
def publishable_artifacts(spark, d):
    part = read(spark, d, "part")
    part.createOrReplaceTempView("lodestar_part")
    return files.publishable(spark.sql(_LISTED.replace("FROM part", "FROM lodestar_part")))


@register("SELECT tag FROM (SELECT 'v' || (p_partkey % 3) || '.' || (p_size % 20) || '.' || (p_partkey % 12) || CASE WHEN p_partkey % 50 = 0 THEN 'rc' ELSE '' END AS tag FROM part) WHERE regexp_matches(tag, '^v[0-9]+\\.[0-9]+\\.[0-9]+$') AND list_transform(string_split(tag[2:], '.'), lambda x: x::INT) > [1, 9, 10]")
def newer_releases(spark, d):
    tag = F.expr("concat('v', p_partkey % 3, '.', p_size % 20, '.', p_partkey % 12, if(p_partkey % 50 = 0, 'rc', ''))")
    return files.newer_release(read(spark, d, "part").select(tag.alias("tag")), "v1.9.10")


@register("WITH a AS (SELECT n_nationkey AS k, '1.' || (n_nationkey % 4) || '.0' AS v, n_nationkey % 3 AS m FROM nation) SELECT v AS version, coalesce((SELECT 'r' || min(k) FROM a b WHERE (b.v = w.v AND b.m <> 1) OR (b.v = w.v AND b.m = 9)), 'none') AS tag FROM (SELECT DISTINCT v FROM a UNION SELECT '.0.0') w")
def matching_releases(spark, d):
    """The first release of each version that holds both of its indexes, or one archive with both: of three releases one
    has the lexical index alone. Parts of a version's name match nothing."""
    rows = sorted(r["n_nationkey"] for r in read(spark, d, "nation").select("n_nationkey").collect())
    names = {0: ["{}-lexical.zip", "{}-vectors.zip"], 1: ["{}-lexical.zip"], 2: ["{}.zip"]}
    releases = [{"tag": f"r{k}", "assets": [{"name": n.format(f"1.{k % 4}.0")} for n in names[k % 3]]} for k in rows]
    versions = sorted({f"1.{k % 4}.0" for k in rows}) + [".0.0"]
    return spark.createDataFrame([(v, (catalog.matching_release(releases, v) or {"tag": "none"})["tag"]) for v in versions], "version string, tag string")


@register("SELECT 'README.txt' AS name UNION ALL SELECT 'vectors/a' UNION ALL SELECT 'lexical/postings/a' UNION ALL SELECT 'ranked.jsonl/a'")
def packaged_version(spark, d):
    """What a version's publishable archive holds."""
    data = made_folder(spark, "call")
    for name in ("vectors/a", "lexical/postings/a", "ranked.jsonl/a", "source/x.plsql", "contents/a"):
        os.makedirs(os.path.dirname(f"{Paths.of(data, 'v').base}/{name}"), exist_ok=True)
        with open(f"{Paths.of(data, 'v').base}/{name}", "w") as f:
            f.write("x" * 1000)
    made = catalog.package(data, "v")
    names = zipfile.ZipFile(made["path"]).namelist()
    assert made["original_size"] == 3000 and 0 < made["smaller_by_percent"] < 100
    shutil.rmtree(data)
    return spark.createDataFrame([(n,) for n in names], "name string")


# --- models' places and the rest ----------------------------------------------------------------------------------------------

_BLANK = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


@register(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    s AS (SELECT doc_id, pos, regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS line FROM l), f AS (SELECT doc_id, arg_min(line, pos) AS line FROM s WHERE line <> '' GROUP BY doc_id)
    SELECT d.doc_id AS path, coalesce(line, '') AS summary, TRUE AS has_ai_summary, (length(text) // 4)::INT AS tokens_used FROM documents d LEFT JOIN f USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""
)
def resumed_summaries(spark, d):
    """The summary phase where a log covers some files: only the others are summarised."""
    tree = read(spark, d, "documents").select(F.col("doc_id").alias("relative_path"), F.col("text").alias("content"))
    log = read(spark, d, "labels").select(F.col("doc_id").alias("path"), (F.col("quality") == 1).alias("success"))
    return corpus.summaries(tree, log, models.first_line_summariser).select("path", "summary", "has_ai_summary", "tokens_used")


@register("SELECT doc_id, 64 AS dims, 1.0::DOUBLE AS length FROM documents WHERE regexp_matches(text, '[a-z]')")
def embedded_texts(spark, d):
    """The stand-in embedder over whole texts: vectors of length one."""
    rows = read(spark, d, "documents").where("text rlike '[a-z]'").select("doc_id", "text")
    v = models.embed(rows, "text", models.hashing_embedder).select("doc_id", "embedding")
    return v.select("doc_id", F.size("embedding").alias("dims"), F.round(F.sqrt(vector.inner_product(F.col("embedding"), F.col("embedding"))), 5).alias("length"))


#: Texts with the tokens that the byte-pair vocabulary cuts them into, cleaned like words.
_PIECES = {"Customer_Order validates credit": "customer order valid ates credit", "rounding of totals 2024": "round ing totals", "": "", "if x > 10 then": ""}


@register("SELECT unnest([" + ", ".join(f"'{t}'" for t in _PIECES) + "]) AS content, unnest([" + ", ".join(f"'{t}'" for t in _PIECES.values()) + "]) AS tokens")
def subword_tokens(spark, d):
    import public_tokenizers

    rows = spark.createDataFrame([(t,) for t in _PIECES], "content string")
    found = tokenize.subword_tokens(F.col("content"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, text.stopwords())
    return rows.select("content", F.array_join(found, " ").alias("tokens"))


@register("SELECT unnest(['A.plsql', 'sub/B.plsql']) AS relative_path")
def readable_sources(spark, d):
    """A scan that meets a file that cannot be read: the others come through."""
    root = made_folder(spark, "call")
    os.makedirs(f"{root}/sub")
    for name in ("A.plsql", "sub/B.plsql", "sub/C.txt"):
        with open(f"{root}/{name}", "w") as f:
            f.write("x")
    os.symlink(f"{root}/nowhere", f"{root}/Gone.plsql")
    return files.source_tree(spark, root).select("relative_path")


@register("SELECT unnest(['hybrid', 'semantic', 'lexical', 'odd']) AS mode, unnest([TRUE, TRUE, TRUE, FALSE]) AS answered")
def search_modes(spark, d):
    """The search tool in each of its modes, and in one that it has not."""
    from . import tools

    engine = _engine(spark, d, True)
    said = {m: tools.search_codebase(engine, ASKED, search_mode=m, max_results=3) for m in ("hybrid", "semantic", "lexical", "odd")}
    assert tools.search_semantic(engine, ASKED, 3).splitlines()[2:] and tools.development_guidance()
    return spark.createDataFrame([(m, x.startswith("# ")) for m, x in said.items()], "mode string, answered boolean")


@register("SELECT unnest(['lexical/postings/a', 'ranked.jsonl/a', 'vectors/a', 'README.txt']) AS path")
def downloaded_version(spark, d):
    """A version packed, offered as a release's asset, and fetched and unpacked elsewhere."""
    a, b = made_folder(spark, "call"), made_folder(spark, "call")
    for name in ("vectors/a", "lexical/postings/a", "ranked.jsonl/a", "source/x.plsql"):
        os.makedirs(os.path.dirname(f"{Paths.of(a, '7.1').base}/{name}"), exist_ok=True)
        with open(f"{Paths.of(a, '7.1').base}/{name}", "w") as f:
            f.write("x")
    packed = catalog.package(a, "7.1")["path"]
    releases = [{"tag_name": "r0", "assets": [{"name": "17.1.zip", "browser_download_url": "file:///nowhere"}]}, {"tag_name": "r1", "assets": [{"name": "7.1.zip", "browser_download_url": f"file://{packed}"}]}]
    status = catalog.download(releases, "7.1", b)
    found = [os.path.relpath(os.path.join(folder, n), status.extract_path) for folder, _, names in os.walk(status.extract_path) for n in names]
    assert status.is_ready
    shutil.rmtree(a)
    shutil.rmtree(b)
    return spark.createDataFrame([(f,) for f in found], "path string")


@register("SELECT * FROM (VALUES (1, 'import', 0), (2, 'list', 0), (3, 'analyze', 0), (4, 'search', 1), (5, 'delete', 0), (6, 'delete', 1)) v(step, command, code)")
def command_line(spark, d):
    """Exit codes of commands on a small release; a search without an index fails, and so does deleting twice."""
    import contextlib
    import io

    from . import cli

    data = made_folder(spark, "call")
    with zipfile.ZipFile(f"{data}/r.zip", "w") as z:
        z.writestr("checkout/fndbas/source/version.txt", "8.2.0\n")
        z.writestr("checkout/a/One.plsql", "PROCEDURE Do IS\n   Two_API.Run(x);\n")
        z.writestr("checkout/a/Two.plsql", "PROCEDURE Run IS\n")
    steps = [("import", f"{data}/r.zip"), ("list", "--json"), ("analyze", "--version", "8.2.0"), ("search", "--version", "8.2.0", "run"), ("delete", "8.2.0", "--force"), ("delete", "8.2.0", "--force")]
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        codes = [cli.main(["--data", data, *s], spark) for s in steps]
    shutil.rmtree(data)
    return spark.createDataFrame([(i, s[0], c) for i, (s, c) in enumerate(zip(steps, codes, strict=True), 1)], "step int, command string, code int")
