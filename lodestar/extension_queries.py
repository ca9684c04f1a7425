"""EXTENSIONS: queries of what the system this follows announces but does not have, over the given tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import storage
from .functions import text
from .operators import intent, late, query, suggest
from .queries import _TOKENS, FILES_CTE, QUERY_TERMS, files, read, register, tokens
from .streaming import changes

_TYPED = "replace(replace(replace(p_name, 'll', 'l'), 'dg', 'gd'), 'ea', 'aea')"


@register(f"WITH q AS (SELECT DISTINCT {_TYPED} AS query FROM part UNION SELECT substr(p_name, 2) FROM part), n AS (SELECT DISTINCT p_name AS name FROM part) SELECT query, name, levenshtein(query, name)::INT AS distance, round(100 - 100.0::DOUBLE * levenshtein(query, name) / greatest(length(query), length(name)), 6) AS ratio FROM q, n WHERE 100 * (greatest(length(query), length(name)) - levenshtein(query, name)) >= 80 * greatest(length(query), length(name))")
def fuzzy_part_names(spark, d):
    """Mistyped names of parts, and the names within a ratio of 80."""
    part = read(spark, d, "part")
    typed = part.select(F.expr(_TYPED).alias("name")).unionByName(part.select(F.expr("substr(p_name, 2)").alias("name")))
    return suggest.fuzzy_matches(typed, part.select(F.col("p_name").alias("name")), 80).select("query", "name", "distance", F.round("ratio", 6).alias("ratio"))


@register(FILES_CTE + ", n AS (SELECT DISTINCT file_name AS name FROM files) SELECT a.name AS query, b.name, levenshtein(a.name, b.name)::INT AS distance FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 3 WHERE 100 * (greatest(length(a.name), length(b.name)) - levenshtein(a.name, b.name)) >= 92 * greatest(length(a.name), length(b.name))")
def fuzzy_file_names(spark, d):
    """Pairs of file names within a ratio of 92."""
    names = files(spark, d).select(F.col("file_name").alias("name"))
    return suggest.fuzzy_matches(names, names, 92).where("query < name").select("query", "name", "distance")


@register("WITH n AS (SELECT p_name AS name, sum(p_size)::BIGINT AS weight FROM part GROUP BY 1), p AS (SELECT unnest(list_transform(range(1, length(name) + 1), lambda i: lower(left(name, i)))) AS prefix, name, weight FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, name)::INT AS place FROM p) SELECT * FROM r WHERE place <= 5")
def name_completions(spark, d):
    """For all prefixes of the parts' names the five heaviest names."""
    names = read(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("weight"))
    return suggest.completions(names, 5)


@register("WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS name FROM documents), n AS (SELECT name, count(*) AS weight FROM w GROUP BY 1), p AS (SELECT unnest(list_transform(range(1, least(6, length(name)) + 1), lambda i: left(name, i))) AS prefix, name, weight FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, name)::INT AS place FROM p) SELECT * FROM r WHERE place <= 3")
def word_completions(spark, d):
    """For all prefixes up to six letters of the words in the documents the three most frequent words."""
    words = read(spark, d, "documents").select(F.explode(text.basic_tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("name"), F.lit(1).alias("weight"))
    return suggest.completions(words, 3, longest=6)


_SIZE = "CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END"


@register(
    f"""WITH {_TOKENS}, h AS (SELECT d.lang, d.source, {_SIZE} AS size FROM documents d JOIN t ON t.doc_id = d.doc_id WHERE list_has_any(t.tokens, {QUERY_TERMS}))
    SELECT 'language' AS facet, lang AS value, count(*) AS n FROM h WHERE source LIKE 'src1%' AND size <> 'long' GROUP BY lang
    UNION ALL SELECT 'module', source, count(*) FROM h WHERE lang IN ('en', 'de') AND size <> 'long' GROUP BY source
    UNION ALL SELECT 'size', size, count(*) FROM h WHERE lang IN ('en', 'de') AND source LIKE 'src1%' GROUP BY size"""
)
def search_facets(spark, d):
    """Facets of all documents that hold a word of the query: language, module and size, each counted under the filters
    of the other two."""
    holds = tokens(spark, d).where(F.arrays_overlap("tokens", F.array(*map(F.lit, QUERY_TERMS)))).select("doc_id")
    hits = read(spark, d, "documents").join(holds, "doc_id")
    size = F.expr(_SIZE)
    values = {"language": F.col("lang"), "module": F.col("source"), "size": size}
    chosen = {"language": F.col("lang").isin("en", "de"), "module": F.startswith("source", F.lit("src1")), "size": size != "long"}
    return suggest.facets(hits, chosen, values)


@register(
    """WITH l AS (SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS listing, user_id::VARCHAR AS path, (count(*) % 3)::VARCHAR AS hash FROM events GROUP BY event_type, user_id),
    c AS (SELECT coalesce(b.listing, a.listing + 1) AS listing, CASE WHEN a.path IS NULL THEN 'insert' WHEN b.path IS NULL THEN 'delete' ELSE 'update' END AS change, coalesce(b.path, a.path) AS path, b.hash
      FROM l a FULL JOIN l b ON b.listing = a.listing + 1 AND b.path = a.path WHERE a.hash IS DISTINCT FROM b.hash)
    SELECT * FROM c WHERE listing <= (SELECT max(listing) FROM l)"""
)
def tracked_changes(spark, d):
    """A listing for each type of event, of the users that have some, followed by the stateful stream: what each listing
    adds, changes and removes."""
    folder, out, checkpoint = (storage.scratch_path(spark, name) for name in ("listings", "changes", "stream"))
    events = read(spark, d, "events").groupBy("event_type", F.col("user_id").cast("string").alias("path")).agg((F.count("*") % 3).cast("string").alias("hash"))
    types = sorted(r["event_type"] for r in events.select("event_type").distinct().collect())  # a handful
    for n, kind in enumerate(types):
        changes.write_listing(events.where(F.col("event_type") == kind).select("path", "hash"), n, folder, buckets=8)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = changes.changes(spark, folder).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changes.CHANGE).parquet(out).select("listing", "change", "path", "hash")


@register(
    """WITH e AS (SELECT vec_id, vec_id // 4 AS doc, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    p AS (SELECT q.doc AS query_id, q.vec_id, c.doc AS doc_id, max(list_inner_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(c.embedding, lambda x: x::DOUBLE))) AS best FROM e q JOIN e c ON q.doc % 25 = 0 AND q.doc <> c.doc GROUP BY ALL),
    s AS (SELECT query_id, doc_id, round(sum(best), 9) AS score FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
    SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10"""
)
def late_interaction(spark, d):
    """Four vectors a document; every 25th document asks with its own, all documents answer."""
    rows = read(spark, d, "embeddings").where("vec_id is not null").withColumn("doc", F.expr("vec_id div 4"))
    docs = late.token_vectors(rows, "doc", "vec_id", "embedding")
    return late.max_sim(docs, docs.where("doc_id % 25 = 0"), 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


_INTENTS = """SELECT 'exact_match' AS type, upper(replace(p_name, ' ', '_')) || '_API' AS query, p_partkey AS k FROM {part} UNION ALL SELECT 'exact_match', replace(initcap(p_name), ' ', '') || '.' || replace(p_brand, '#', ''), p_partkey FROM {part}
    UNION ALL SELECT 'code_pattern', 'select ' || split(p_name, ' ')[0] || ' from ' || lower(p_type) || '_tab', p_partkey FROM {part} UNION ALL SELECT 'code_pattern', 'procedure check_' || split(p_name, ' ')[1] || ' in ' || lower(p_type), p_partkey FROM {part}
    UNION ALL SELECT 'semantic', 'why are ' || p_name || ' orders of ' || p_brand || ' refused', p_partkey FROM {part} UNION ALL SELECT 'semantic', 'what is the purpose of ' || p_name, p_partkey FROM {part} UNION ALL SELECT 'semantic', 'explain when a ' || p_name || ' is ' || lower(p_type), p_partkey FROM {part}
    UNION ALL SELECT 'mixed', p_name || ' ' || lower(p_type), p_partkey FROM {part} UNION ALL SELECT 'mixed', split(p_name, ' ')[1] || ' ' || p_brand || ' stock', p_partkey FROM {part}"""


@register(None)
def trained_intent(spark, d):
    """Types of queries in nine forms made of the parts, learned from four parts in five and held against the fifth,
    beside the rules: rows and right answers of each type. Some forms hold none of the rules' phrases."""
    every = spark.sql(_INTENTS, part=read(spark, d, "part"))
    held_out = F.pmod(F.xxhash64("k"), F.lit(5)) == 0
    model = intent.train(every.where(~held_out).select("query", "type"))
    found = intent.classify(model, every.where(held_out).select("query", "type"), "learned").withColumn("ruled", query.query_type(F.col("query")))
    right = lambda c: F.count_if(F.col(c) == F.col("type")).alias(c)
    return found.groupBy("type").agg(F.count("*").alias("n"), right("learned"), right("ruled"))
