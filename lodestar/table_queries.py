"""Queries that run the parts of the library which work on names, folders, archives and single queries over the given
tables, with the equivalent DuckDB SQL."""

from __future__ import annotations

import os
import re
import shutil
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import extract
from .operators import lexical, query
from .plans import corpus, phases
from .plans.search import SearchConfig
from .queries import _CAPITALS, _TOKENS, FILES, FILES_CTE, read, register, tokens
from .sources import catalog, files
from .sources.archive import write_archive
from .sources.catalog import Paths
from .tree_queries import _BOOSTED, _HIGH, _LEX, _RECORDS, _SHOWN, _SNIPPET, ASKED, _DOT, _engine, _records, made_folder, source

# --- query analysis -----------------------------------------------------------------------------------------------------------

_ASKED = "q AS (SELECT text AS query FROM conversations UNION ALL SELECT p_type FROM part UNION ALL SELECT upper(replace(p_name, ' ', '_')) || '_API' FROM part UNION ALL SELECT upper(replace(p_name, ' ', '_')) FROM part UNION ALL SELECT 'how to process ' || p_name FROM part UNION ALL SELECT 'create ' || p_name || ' get error' FROM part UNION ALL SELECT p_name || '.' || p_brand FROM part UNION ALL SELECT 'function ' || p_brand FROM part UNION ALL SELECT text FROM benchmark)"


def _asked(spark, d) -> DataFrame:
    """What people ask: turns of conversations, benchmark items, and names of parts in the forms that queries have."""
    name, brand = F.col("p_name"), F.col("p_brand")
    upper = F.upper(F.replace(name, F.lit(" "), F.lit("_")))
    forms = [F.col("p_type"), F.concat(upper, F.lit("_API")), upper, F.concat(F.lit("how to process "), name), F.concat(F.lit("create "), name, F.lit(" get error")), F.concat(name, F.lit("."), brand), F.concat(F.lit("function "), brand)]
    parts = read(spark, d, "part").select(F.explode(F.array(*forms)).alias("query"))
    return read(spark, d, "conversations").select(F.col("text").alias("query")).unionByName(read(spark, d, "benchmark").select(F.col("text").alias("query"))).unionByName(parts)


@register(
    f"""WITH {_ASKED}, k AS (SELECT query, CASE WHEN regexp_matches(query, '(?i)[A-Z_]+_API$') OR regexp_matches(query, '(?i)[A-Za-z]+API$') OR regexp_matches(query, '[A-Za-z_]+\\.[A-Za-z_]+') OR {_CAPITALS} THEN 'exact_match'
    WHEN regexp_matches(query, '(?i)SELECT\\s+.*FROM|PROCEDURE\\s+\\w+|FUNCTION\\s+\\w+|Error_SYS\\.|RAISE_APPLICATION_ERROR') THEN 'code_pattern'
    WHEN regexp_matches(lower(query), 'how to|what is|why does|business logic|functionality|purpose|workflow|process') THEN 'semantic' ELSE 'mixed' END AS type FROM q)
    SELECT query, type, CASE type WHEN 'exact_match' THEN 0.2::DOUBLE WHEN 'code_pattern' THEN 0.3::DOUBLE WHEN 'semantic' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS vector_weight FROM k"""
)
def query_types(spark, d):
    """Type and weights of all queries of a table."""
    kind = query.query_type(F.col("query"))
    return _asked(spark, d).select("query", kind.alias("type"), query.weights(kind)[1].alias("vector_weight"))


@register(
    f"""WITH {_ASKED}, w AS (SELECT query, list_transform(string_split(query, '_'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))) AS camel,
      flatten(list_transform(regexp_extract_all(lower(query), '[^\\s]+'), lambda x: CASE x WHEN 'error' THEN ['exception', 'failure', 'issue'] WHEN 'create' THEN ['insert', 'add', 'new']
      WHEN 'update' THEN ['modify', 'change', 'edit'] WHEN 'delete' THEN ['remove', 'drop'] WHEN 'get' THEN ['retrieve', 'fetch', 'select'] ELSE [] END)) AS syn FROM q)
    SELECT query, array_to_string(list_concat(CASE WHEN {_CAPITALS} AND contains(query, '_') THEN [array_to_string(camel, '')] ELSE [] END, syn)[1:3], ',') AS expansions FROM w"""
)
def query_expansions(spark, d):
    """Camel case and synonyms, three at most."""
    return _asked(spark, d).select("query", F.array_join(query.expansions(F.col("query")), ",").alias("expansions"))


# --- texts and vectors of records ------------------------------------------------------------------------------------------------


@register(_RECORDS + " SELECT file_id, 'Business Function: stands for ' || file_name || ' | Component: ' || api_name || ' in ' || file_name || ' | Domain: ' || replace(replace(api_name, '_API', ''), '_', ' ') || ' | System Importance: Rank ' || file_id || ' of 9750 | Dependencies: ' || len(api_calls) || ' API calls including ' || CASE WHEN len(api_calls) > 0 THEN array_to_string(api_calls[1:5], ', ') ELSE 'none' END || ' | Implementation: ' || len(api_calls) || ' key procedures/functions' AS described FROM r")
def whole_embedding_texts(spark, d):
    """All parts of the text that is embedded; the calls stand for the declared names as well."""
    calls = F.col("api_calls")
    made = extract.embedding_text(F.concat(F.lit("stands for "), "file_name"), F.col("api_name"), F.col("file_name"), F.col("rank"), calls, calls)
    return _records(spark, d).select("file_id", made.alias("described"))


#: Letters whose frequencies are the stand-in embedder's vector.
_LETTERS = "aeiorstn"


def letter_embedder():
    """STAND-IN: how often a text holds each of some letters; SQL can say the same."""
    return lambda texts: np.array([[t.count(c) for c in _LETTERS] for t in texts], np.float64)


_COUNTS = "[" + ", ".join(f"length(x) - length(replace(x, '{c}', ''))" for c in _LETTERS) + "]"


@register(
    f"""WITH t AS (SELECT d.doc_id, 'Business Function: ' || lang || ' prose | Component: ' || upper(source) || ' in ' || source || '.txt | Domain: ' || upper(source) || ' | System Importance: Rank ' || n_chars || ' of 9750 | Dependencies: 1 API calls including ' || lang || ' | Implementation: 0 key procedures/functions' AS x
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)),
    v AS (SELECT doc_id, {_COUNTS} AS v FROM t), n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS n FROM v)
    SELECT doc_id::VARCHAR AS vec_id, array_to_string(list_transform(v, lambda a: round(10000 * a / n)::BIGINT), ',') AS vector FROM n"""
)
def embedding_phase(spark, d):
    """The embedding phase where some vectors are written already: files with a summary, joined to their ranking record,
    described, embedded and normalised; the others are left alone."""
    docs, path = read(spark, d, "documents"), F.col("doc_id").cast("string")
    labels = read(spark, d, "labels").where("quality = 1").select(path.alias("path"))
    results = docs.select(path.alias("path"), F.concat("lang", F.lit(" prose")).alias("summary")).join(labels, "path").withColumn("has_ai_summary", F.lit(True))
    ranked = docs.select(path.alias("relative_path"), F.upper("source").alias("api_name"), F.concat("source", F.lit(".txt")).alias("file_name"), F.col("n_chars").alias("pagerank_rank"), F.array("lang").alias("api_calls"), F.array().cast("array<string>").alias("procedure_function_names"))
    done = read(spark, d, "embeddings").where("vec_id is not null").select(F.col("vec_id").cast("string").alias("vec_id"))
    made = corpus.embeddings(corpus.not_embedded(results, done), ranked, letter_embedder)
    return made.select("vec_id", F.array_join(F.transform("embedding", lambda x: F.round(x * 10000).cast("long")), ",").alias("vector"))


# --- archives and folders ----------------------------------------------------------------------------------------------------------


@register("SELECT n_name || '.zip' AS archive, CASE WHEN n_nationkey % 5 <> 4 THEN '24.' || n_regionkey || '.' || n_nationkey END AS version FROM nation")
def archive_versions(spark, d):
    """The versions that archives name, an archive a nation; of some the member says none."""
    top = made_folder(spark, "call")
    for r in read(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey").collect():  # 25 rows
        body = f"# {r.n_name}\n\n // no version\n" + (f"  24.{r.n_regionkey}.{r.n_nationkey} build {r.n_name}\n1.0\n" if r.n_nationkey % 5 != 4 else "")
        with zipfile.ZipFile(f"{top}/{r.n_name}.zip", "w") as z:
            z.writestr("checkout/a/B.plsql", "x")
            z.writestr("checkout/fndbas/source/version.txt", body)
    rows = files.archive_versions(spark, top).collect()
    shutil.rmtree(top)
    return spark.createDataFrame([(os.path.basename(r.archive), r.version) for r in rows], "archive string, version string")


_SUFFIX = "CASE p_partkey % 11 WHEN 0 THEN '.plsql' WHEN 1 THEN '.ENTITY' WHEN 2 THEN '.views' WHEN 3 THEN '.storage' WHEN 4 THEN '.Fragment' WHEN 5 THEN '.projection' WHEN 6 THEN '.client' WHEN 7 THEN '.txt' WHEN 8 THEN '.plsql.bak' WHEN 9 THEN '' ELSE '.sql' END"
_ENTRY = f"concat(CASE p_size % 4 WHEN 0 THEN 'other/' ELSE 'checkout/' END, 'm', CAST(p_size AS STRING), '/F', CAST(p_partkey AS STRING), {_SUFFIX})"


@register(f"SELECT substr(e, 10) AS relative_path, sha256(p_name) AS hash FROM (SELECT {_ENTRY} AS e, p_name, p_size, p_partkey FROM part) WHERE e LIKE 'checkout/%' AND regexp_matches(lower(e), '\\.(entity|plsql|views|storage|fragment|projection|client)$')")
def archived_suffixes(spark, d):
    """An archive of all kinds of names, written and read by many tasks: source files by suffix in any case, below the root."""
    top = made_folder(spark, "call")
    write_archive(read(spark, d, "part").select(F.expr(_ENTRY).alias("entry"), F.col("p_name").cast("binary").alias("content")), f"{top}/x.zip")
    return files.archive_entries(spark, f"{top}/x.zip", partition_bytes=32 << 10).select("relative_path", F.sha2("content", 256).alias("hash"))


@register(FILES_CTE + " SELECT relative_path FROM files WHERE file_id % 4 <> 0")
def linked_sources(spark, d):
    """A scan of a tree in which a quarter of the files has gone: the others come through."""
    top = made_folder(spark, "call")
    tree = source(spark, d).select("file_path", "relative_path")
    ids = read(spark, d, "part").selectExpr("p_partkey AS file_id", f"{FILES['relative_path']} AS relative_path")

    def link(batches):
        for batch in batches:
            for path, relative, gone in zip(*[batch[c].to_pylist() for c in ("file_path", "relative_path", "gone")], strict=True):
                os.makedirs(os.path.dirname(f"{top}/{relative}"), exist_ok=True)
                os.symlink(path.removeprefix("file:") + ("-gone" if gone else ""), f"{top}/{relative}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    tree.join(ids, "relative_path").select("file_path", "relative_path", (F.col("file_id") % 4 == 0).alias("gone")).mapInArrow(link, "n long").agg(F.sum("n")).collect()
    return files.source_tree(spark, top).select("relative_path")


@register("SELECT r_regionkey, repeat('down/', r_regionkey::INT) || r_name AS found FROM region")
def work_folders(spark, d):
    """Single folders are descended, as deep as each region's number says, to one that holds both markers."""
    top, rows = made_folder(spark, "call"), []
    for r in read(spark, d, "region").select("r_regionkey", F.trim("r_name").alias("name")).collect():  # five rows
        home = f"{top}/{r.r_regionkey}/{'down/' * r.r_regionkey}{r.name}"
        for marker in ("fndbas", "order"):
            os.makedirs(f"{home}/{marker}")
        rows.append((r.r_regionkey, os.path.relpath(catalog.work_root(f"{top}/{r.r_regionkey}"), f"{top}/{r.r_regionkey}")))
    shutil.rmtree(top)
    return spark.createDataFrame(rows, "r_regionkey int, found string")


@register("SELECT n_nationkey, 'data/versions/' || regexp_replace(n_name || ' v1/' || n_regionkey, '[^A-Za-z0-9._-]', '', 'g') || '/' || unnest(['source', 'analysis', 'lexical', 'vectors', 'contents', 'ranked.jsonl', 'checkpoints']) AS place FROM nation")
def version_places(spark, d):
    """Where the parts of versions lie whose names hold all kinds of characters."""
    rows = []
    for r in read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():  # 25 rows
        p = Paths.of("data", f"{r.n_name} v1/{r.n_regionkey}")
        rows += [(r.n_nationkey, x) for x in (p.source, p.analysis, p.lexical, p.vectors, p.contents, p.ranked, p.checkpoints)]
    return spark.createDataFrame(rows, "n_nationkey int, place string")


@register("SELECT 'name of ' || n_regionkey || '/' || n_name AS key, n_name AS value FROM nation WHERE n_regionkey <> 0")
def saved_metadata(spark, d):
    """A run's metadata in place of those that were saved before."""
    path = f"{made_folder(spark, "call")}/meta"
    rows = {f"name of {r.n_regionkey}/{r.n_name}": (r.n_name, r.n_regionkey) for r in read(spark, d, "nation").select("n_name", "n_regionkey").collect()}  # 25 rows
    phases.save_metadata(spark, {k: v for k, (v, _) in rows.items()}, path)
    phases.save_metadata(spark, {k: v for k, (v, region) in rows.items() if region != 0}, path)
    return spark.read.parquet(path).where("saved_at is not null").select("key", "value")


@register("SELECT 'v' || n_nationkey AS version, row_number() OVER (ORDER BY n_nationkey DESC)::INT AS place, n_regionkey = 2 AS has_lexical FROM nation WHERE n_regionkey <> 1")
def versions_by_creation(spark, d):
    """Versions made one after the other, some of them deleted, listed from the newest on; unconfirmed deletions do nothing."""
    data = made_folder(spark, "call")
    nations = read(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    for r in nations:
        os.makedirs(f"{Paths.of(data, f'v{r.n_nationkey}').lexical}" + ("/postings" if r.n_regionkey == 2 else ""))
    for r in nations:
        if catalog.delete_version(data, f"v{r.n_nationkey}", confirmed=r.n_regionkey == 1) != (r.n_regionkey == 1):
            raise ValueError("a version was deleted unasked, or not when asked")
    rows = [(s.version, i, s.has_lexical) for i, s in enumerate(catalog.versions(data), 1)]
    shutil.rmtree(data)
    return spark.createDataFrame(rows, "version string, place int, has_lexical boolean")


@register("WITH f AS (SELECT n_regionkey, CASE n_nationkey % 3 WHEN 0 THEN 'vectors/' WHEN 1 THEN 'lexical/blocks/' ELSE 'source/' END || n_nationkey AS path, 40 * length(n_name) AS size, n_nationkey % 3 <> 2 AS published FROM nation), t AS (SELECT n_regionkey, sum(size) FILTER (published)::BIGINT AS original_size FROM f GROUP BY 1) SELECT r_name AS version, path, original_size, TRUE AS smaller FROM (SELECT n_regionkey, path FROM f WHERE published UNION ALL SELECT n_regionkey, 'README.txt' FROM t WHERE original_size IS NOT NULL) JOIN t USING (n_regionkey) JOIN region ON r_regionkey = n_regionkey")
def published_versions(spark, d):
    """Versions packed, offered as assets of releases, and fetched and unpacked elsewhere: what comes out, and the sizes."""
    a, b, rows, releases = made_folder(spark, "call"), made_folder(spark, "call"), [], []
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name").collect()  # 25 rows
    for n in nations:
        place = f"{Paths.of(a, n.r_name).base}/{('vectors', 'lexical/blocks', 'source')[n.n_nationkey % 3]}/{n.n_nationkey}"
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(place, "w", encoding="utf-8") as f:
            f.write(n.n_name * 40)
    made = {v: catalog.package(a, v) for v in sorted({n.r_name for n in nations})}
    releases = [{"tag_name": v, "assets": [{"name": f"{v}.zip", "browser_download_url": f"file://{m['path']}"}]} for v, m in made.items()]
    for v, m in made.items():
        home = catalog.download(releases, v, b).extract_path
        rows += [(v, os.path.relpath(os.path.join(folder, n), home), m["original_size"], 0 < m["smaller_by_percent"] < 100) for folder, _, names in os.walk(home) for n in names]
    shutil.rmtree(a)
    shutil.rmtree(b)
    return spark.createDataFrame(rows, "version string, path string, original_size long, smaller boolean")


# --- search ------------------------------------------------------------------------------------------------------------------------


def _hybrid(fetch: int) -> str:
    """The hybrid search's result (path, score) as SQL, of sides that fetch so many hits."""
    vec = f"SELECT a.vec_id::VARCHAR AS path, {_DOT} AS score FROM embeddings a JOIN documents ON doc_id = a.vec_id, embeddings b WHERE b.vec_id = 7 AND {_DOT} > 0 ORDER BY 2 DESC, 1 LIMIT {fetch}"
    return f"(WITH {_LEX.replace('LIMIT 20', f'LIMIT {fetch}')}, vec AS ({vec}), a AS {_BOOSTED.format('lex', 5)}, b AS {_BOOSTED.format('vec', 5)} SELECT path, CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN (a.score + b.score) / 2 ELSE coalesce(a.score, b.score) END AS score FROM a FULL JOIN b USING (path))"


@register(
    f"""WITH s AS (WITH {_LEX.replace('LIMIT 20', 'LIMIT 10')} SELECT * FROM {_BOOSTED.format('lex', 10)})
    SELECT 'slow_hardware' AS preset, 'pagerank_lexical_only' AS method, path, round(score, 6) AS score FROM s UNION ALL
    SELECT 'medium_hardware', 'pagerank_weighted', path, round(score, 6) FROM {_hybrid(20)} UNION ALL SELECT 'fast_hardware', 'pagerank_weighted', path, round(score, 6) FROM {_hybrid(40)}"""
)
def search_presets(spark, d):
    """The search under each preset; no reranker is given, so the fast one does not rerank."""
    engine, out = _engine(spark, d, True), []
    for config in (SearchConfig.slow_hardware(), SearchConfig.medium_hardware(), SearchConfig.fast_hardware()):
        found = engine.search(ASKED, top_k=10, config=config)
        out.append(found.results.select(F.lit(config.preset_name).alias("preset"), F.lit(found.fusion_method).alias("method"), "path", F.round("score", 6).alias("score")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register(
    f"""WITH {_LEX}, {_SNIPPET}, b AS {_BOOSTED.format('lex', 10)}, r AS (SELECT row_number() OVER (ORDER BY b.score DESC, path)::INT AS place, path, b.score, {_SHOWN}, concat_ws(' • ', 'Exact match found in source code', 'Matched through lexical search', {_HIGH}) AS explanation FROM b JOIN documents ON doc_id::VARCHAR = path LEFT JOIN bl USING (doc_id))
    SELECT 0 AS place, '# 10 results for: {ASKED}' || chr(10) || 'type mixed, method pagerank_lexical_only' AS said UNION ALL
    SELECT place, '## ' || place || '. ' || title || chr(10) || '- path: `' || path || '`' || chr(10) || '- score: ' || printf('%.4f', score) || ' (lexical)' || chr(10) || '- ' || explanation || chr(10) || '> ' || snippet FROM r"""
)
def search_markdown(spark, d):
    """All that the search tool says, a row a section, but for the time that it took."""
    from .tools import search_lexical

    said = re.split(r"\n+(?=## )", search_lexical(_engine(spark, d, False), ASKED).rstrip("\n"))
    head = re.sub(r", [0-9.]+ s$", "", said[0].rstrip("\n"))
    return spark.createDataFrame(list(enumerate([head, *(x.rstrip("\n") for x in said[1:])])), "place int, said string")


@register("SELECT (SELECT count(*) FROM documents) AS lexical_documents, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) AS vectors, 2::BIGINT AS cached_queries, FALSE AS initialised")
def engine_stats_after_queries(spark, d):
    """What an engine has loaded and kept after three questions, two of them the same."""
    engine = _engine(spark, d, True)
    for q in (ASKED, ASKED, "process order"):
        engine.vector_hits(q, 3)
    return spark.createDataFrame([tuple(engine.stats().values())], "lexical_documents long, vectors long, cached_queries long, initialised boolean")


@register(f"WITH {_TOKENS} SELECT count(*) AS documents, round(avg(len(tokens)), 2) AS avg_tokens_per_doc, count(*) FILTER (n_chars >= 2000) AS full_content_docs, 3 AS stopwords_count FROM t JOIN documents d ON d.doc_id = t.doc_id")
def index_metadata(spark, d):
    """Documents, mean tokens and documents with their full content, here those of 2,000 characters or more."""
    sizes = read(spark, d, "documents").select("doc_id", "n_chars")
    return lexical.metadata(tokens(spark, d).join(sizes, "doc_id"), F.col("n_chars") >= 2000, stopwords=3)
