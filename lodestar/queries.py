"""Queries over the driver tables, and the equivalent DuckDB SQL.

documents stand in for files, embeddings for their vectors (vec_id is a doc_id), the parts of an order for a call
sequence, events for a processing log. Source files are composed from the part table by one set of SQL expressions that
both engines evaluate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import extract, naming, text
from .operators import fusion, graph, lexical, query, signals, vector
from .plans import phases

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as it lies. With spark.conf lodestar.scan.partitions its rows are dealt to so many partitions first, for
    tables in one row group, which one core would read; unset, nothing is moved."""
    df = spark.read.parquet(f"{d}/{table}.parquet")
    parts = spark.conf.get("lodestar.scan.partitions", None)
    return df.repartition(int(parts)) if parts and table in TEXTS else df


#: Tables whose columns get costly projections.
TEXTS = ("documents", "pages", "benchmark", "part")


# --- the composed source corpus ---------------------------------------------------------------------------------------

_LETTERS = "translate(CAST({} AS STRING), '0123456789', 'abcdefghij')"


def _name(key: str, spaced: bool) -> str:
    a, b = ("Order_Line_", "Customer_") if spaced else ("OrderLine", "Customer")
    return f"concat(CASE ({key}) % 3 WHEN 0 THEN '{b}' WHEN 1 THEN '{a}' ELSE '{'Stock_Item_' if spaced else 'Stock_Item'}' END, chr(CAST(65 + ({key}) % 26 AS INT)), {_LETTERS.format(key)})"


def _call(key: str) -> str:
    return f"concat(upper({_name(key, True)}), '_API')"


_NOTES = [f"CASE WHEN p_partkey % 17 > {i} THEN concat('-- {240101 + i}  SIGN{i}   ', CASE ({i} + p_partkey) % 5 WHEN 0 THEN 'Added credit check' WHEN 1 THEN concat('Fixed  rounding in ', p_type) WHEN 2 THEN concat('ADDED step {i} for ', p_brand) ELSE concat('Changed totals {i} of ', p_name) END) END" for i in range(16)]
_BODY = [
    f"concat('PROCEDURE Get_Name{i}', ' IS')" if i % 6 == 5 else f"CASE WHEN p_partkey % 13 >= {i} THEN concat('{'PROCEDURE' if i % 2 else '  function'} ', CASE WHEN ({i} + p_partkey) % 3 = 0 THEN 'Build_' ELSE 'Calculate_' END, '{chr(65 + i)}x', CASE WHEN (p_partkey + {i}) % 2 = 0 THEN '___' ELSE '' END, ' (x_ IN NUMBER) IS') END"
    for i in range(14)
]
_LINES = [
    "'-- Logical unit: Thing'",
    "'--  Date    Sign    History'",
    "'--  ------  ------  -------------------'",
    *_NOTES,
    "CASE WHEN p_partkey % 17 = 0 THEN concat('-- Created the unit for ', p_brand) END",
    "'/* block comment opens'",
    "'  still inside SELECT nothing'",
    "'and ends */'",
    f"concat('   ', {_call('p_partkey * 3 + 1')}, '.Get_Total(x_);')",
    f"concat('   x_ := ', {_call('p_partkey + 5')}, '.New (y_) + ', lower({_call('p_partkey + 9')}), '.Old(z_);')",
    f"concat('   ', {_call('p_partkey')}, '.Self(x_);')",
    "'   Error_SYS.Record_General(lu_name_, ''NOTFOUND: missing'');'",
    "'   SELECT a INTO b FROM c;'",
    *_BODY,
    "'   total_ := total_ + x_;'",
    "''",
    "'-- ends here: ok'",
    "concat('END ', p_name, ';')",
]
FILES = {
    "file_id": "p_partkey",
    "file_name": f"concat({_name('p_partkey', False)}, '.plsql')",
    "relative_path": f"concat('mod', CAST(p_partkey % 7 AS STRING), '/', {_name('p_partkey', False)}, '.plsql')",
    "content": f"concat_ws(chr(10), {', '.join(_LINES)})",
}
FILES_CTE = f"WITH files AS (SELECT {', '.join(f'{e} AS {n}' for n, e in FILES.items())} FROM part)"
_LINES_CTE = FILES_CTE + ", ls AS (SELECT file_id, string_split(content, chr(10)) AS a FROM files), l AS (SELECT file_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM ls)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(*[F.expr(e).alias(n) for n, e in FILES.items()])


def described(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return f.select("file_id", "relative_path", "file_name", naming.api_name(naming.base_name(F.col("file_name"))).alias("api_name"), extract.api_calls(F.col("content")).alias("api_calls"), F.col("file_id").alias("file_order"))


# --- documents as files -------------------------------------------------------------------------------------------------


@register("SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 1000 AND lang IN ('en', 'de') AND source LIKE 'src1%'")
def scan_filter_documents(spark, d):
    return read(spark, d, "documents").where("n_chars > 1000 and lang in ('en', 'de') and startswith(source, 'src1')").select("doc_id", "lang", "source", "n_chars")


@register("SELECT lang, count(*) AS n_files, round(sum(strlen(text)) / 1048576.0, 6) AS size_mb, max(strlen(text)) AS largest FROM documents GROUP BY lang")
def file_size_stats(spark, d):
    size = F.octet_length("text")
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_files"), F.round(F.sum(size) / 1048576.0, 6).alias("size_mb"), F.max(size.cast("long")).alias("largest"))


@register("SELECT split_part(url, '/', 3) AS host, regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) AS ext, count(*) AS n FROM pages GROUP BY 1, 2")
def count_by_ext(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").groupBy(F.split_part(url, F.lit("/"), F.lit(3)).alias("host"), F.regexp_extract(url, r"\.([A-Za-z0-9]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


@register("SELECT doc_id, sha256(text) AS full_hash, left(sha256(text), 16) AS short_hash, strlen(text) // 1 AS size, length(text) // 4 AS tokens FROM documents")
def content_hash(spark, d):
    c = F.col("text")
    return read(spark, d, "documents").select("doc_id", text.content_hash(c).alias("full_hash"), text.content_hash(c, 16).alias("short_hash"), F.octet_length(c).cast("long").alias("size"), text.estimated_tokens(c).cast("long").alias("tokens"))


@register("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n_tokens, len(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS n_distinct FROM documents")
def tokenize_counts(spark, d):
    t = text.basic_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def tokens(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.transform(text.basic_tokens(F.col("text")), F.lower).alias("tokens"))


_TOKENS = "t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x)) AS tokens FROM documents)"


@register(f"WITH {_TOKENS}, e AS (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM t) SELECT term, count(*) AS df FROM e WHERE length(term) > 2 GROUP BY term")
def doc_freq(spark, d):
    return lexical.document_frequency(tokens(spark, d))


@register(f"WITH {_TOKENS}, e AS (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM t) SELECT term, count(*) AS df FROM e WHERE length(term) > 2 AND term NOT IN ({', '.join(repr(w) for w in text.LANGUAGE_KEYWORDS)}) GROUP BY term HAVING count(*) > 0.2 * (SELECT count(*) FROM documents)")
def corpus_stopwords(spark, d):
    return lexical.corpus_stopwords(tokens(spark, d), share=0.2)


QUERY_TERMS = ["thand", "ering", "eaux", "keit"]
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))"


@register(
    f"""WITH {_TOKENS}, q AS (SELECT unnest({QUERY_TERMS}) AS term), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
    p AS (SELECT doc_id, len(tokens) AS dl, term, len(list_filter(tokens, lambda x: x = term)) AS tf FROM t, q),
    f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM p GROUP BY term),
    r AS (SELECT doc_id, sum({_BM25}) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, doc_id LIMIT 10"""
)
def bm25_top10(spark, d):
    return lexical.scan_search(tokens(spark, d), QUERY_TERMS, 10).select("doc_id", F.round("score", 6).alias("score"))


@register(
    f"""WITH {_TOKENS}, q AS (SELECT item_id AS query_id, unnest(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x))) AS term FROM benchmark),
    qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
    e AS (SELECT doc_id, unnest(tokens) AS term FROM t), p AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
    r AS (SELECT query_id, p.doc_id, round(sum(times * {_BM25}), 9) AS score FROM qt JOIN p USING (term) JOIN f USING (term) JOIN (SELECT doc_id, len(tokens) AS dl FROM t) USING (doc_id), s GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r)
    SELECT query_id, rank, doc_id, round(score, 5) AS score FROM k WHERE rank <= 3"""
)
def bm25_batch_queries(spark, d):
    index = lexical.build_index(tokens(spark, d))
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.transform(text.basic_tokens(F.col("text")), F.lower).alias("terms"))
    return lexical.search_batch(index, queries, 3).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 5).alias("score"))


@register(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    s AS (SELECT doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line, len(list_filter(['thand', 'the', 'eaux', 'schen'], lambda w: contains(lower(line), w))) AS score FROM l),
    b AS (SELECT doc_id, arg_max(line, score * 1000000 - pos) AS line FROM s WHERE score > 0 AND length(line) > 10 GROUP BY doc_id)
    SELECT doc_id, coalesce(CASE WHEN length(line) > 200 THEN left(line, 200) || '...' ELSE line END, 'No preview available') AS snippet FROM documents LEFT JOIN b USING (doc_id)"""
)
def snippet_best_line(spark, d):
    return read(spark, d, "documents").select("doc_id", text.best_line(F.col("text"), text.query_words(F.lit("Thand THE eaux  schen"))).alias("snippet"))


# --- queries ------------------------------------------------------------------------------------------------------------

SAMPLE_QUERIES = ["CUSTOMER_ORDER_API", "ORDER", "okapi", "e.g. orders", "Error_SYS.Record_General", "Error_SYS.", "select a from t", "procedure New___", "how to validate customer", "process order", "customer validation", "", "CUSTOMER_ORDER", "create order error", "get and delete", "123 456"]
_Q = "q AS (SELECT unnest([" + ", ".join("'" + q + "'" for q in SAMPLE_QUERIES) + "]) AS query)"
_CAPITALS = "(query = upper(query) AND query <> lower(query))"


@register(
    f"""WITH {_Q}, k AS (SELECT query, CASE WHEN regexp_matches(query, '(?i)[A-Z_]+_API$') OR regexp_matches(query, '(?i)[A-Za-z]+API$') OR regexp_matches(query, '[A-Za-z_]+\\.[A-Za-z_]+') OR {_CAPITALS} THEN 'exact_match'
    WHEN regexp_matches(query, '(?i)SELECT\\s+.*FROM|PROCEDURE\\s+\\w+|FUNCTION\\s+\\w+|Error_SYS\\.|RAISE_APPLICATION_ERROR') THEN 'code_pattern'
    WHEN regexp_matches(lower(query), 'how to|what is|why does|business logic|functionality|purpose|workflow|process') THEN 'semantic' ELSE 'mixed' END AS type FROM q)
    SELECT query, type, CASE type WHEN 'exact_match' THEN 0.8::DOUBLE WHEN 'code_pattern' THEN 0.7::DOUBLE WHEN 'semantic' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS lexical_weight FROM k"""
)
def query_classify(spark, d):
    q = spark.createDataFrame([(x,) for x in SAMPLE_QUERIES], "query string")
    kind = query.query_type(F.col("query"))
    return q.select("query", kind.alias("type"), query.weights(kind)[0].alias("lexical_weight"))


@register(
    f"""WITH {_Q}, w AS (SELECT query, list_transform(string_split(query, '_'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))) AS camel,
      flatten(list_transform(list_filter(string_split(lower(query), ' '), lambda x: x <> ''), lambda x: CASE x WHEN 'error' THEN ['exception', 'failure', 'issue'] WHEN 'create' THEN ['insert', 'add', 'new']
      WHEN 'update' THEN ['modify', 'change', 'edit'] WHEN 'delete' THEN ['remove', 'drop'] WHEN 'get' THEN ['retrieve', 'fetch', 'select'] ELSE [] END)) AS syn FROM q)
    SELECT query, array_to_string(list_concat(CASE WHEN {_CAPITALS} AND contains(query, '_') THEN [array_to_string(camel, '')] ELSE [] END, syn)[1:3], ',') AS expansions FROM w"""
)
def query_expand(spark, d):
    q = spark.createDataFrame([(x,) for x in SAMPLE_QUERIES], "query string")
    return q.select("query", F.array_join(query.expansions(F.col("query")), ",").alias("expansions"))


# --- source files -------------------------------------------------------------------------------------------------------


@register(FILES_CTE + f" SELECT p_partkey AS file_id, f.file_name, concat({_name('p_partkey', True)}, '_API') AS api_name, upper(concat({_name('p_partkey', True)}, '_API')) AS api_key FROM part JOIN files f ON f.file_id = p_partkey")
def api_naming(spark, d):
    name = naming.api_name(naming.base_name(F.col("file_name")))
    return files(spark, d).select("file_id", "file_name", name.alias("api_name"), F.upper(name).alias("api_key"))


@register(
    FILES_CTE
    + """ SELECT file_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '(?i)([A-Z][A-Z0-9_]*_API)\\.', 1), lambda x: upper(x)))), ',') AS api_calls,
    array_to_string(list_transform(list_zip(regexp_extract_all(content, '\\b([A-Z][A-Za-z_]*_API)\\.([A-Za-z_]+)\\s*\\(', 1), regexp_extract_all(content, '\\b([A-Z][A-Za-z_]*_API)\\.([A-Za-z_]+)\\s*\\(', 2)), lambda x: x[1] || '.' || x[2])[1:10], ',') AS calls FROM files"""
)
def api_calls(spark, d):
    c = F.col("content")
    return files(spark, d).select("file_id", F.array_join(extract.api_calls(c), ",").alias("api_calls"), F.array_join(extract.qualified_calls(c), ",").alias("calls"))


_SAMPLED = "(n <= 10 OR i = 0 OR i = n - 1 OR i IN (SELECT CAST(floor(1 + (n - 2) / 9.0 * g) AS BIGINT) FROM range(1, 9) r(g)))"


@register(
    _LINES_CTE
    + f""", s AS (SELECT file_id, pos, trim(line) AS line FROM l WHERE pos <= 100),
    w AS (SELECT file_id, pos, list_filter(string_split(regexp_replace(substr(line, 3), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM s
      WHERE line LIKE '--%' AND length(line) > 10 AND NOT regexp_matches(trim(substr(line, 3)), '^[- ]*$') AND NOT (contains(line, 'Date') AND contains(line, 'Sign') AND contains(line, 'History'))
      AND line NOT LIKE '%-' AND NOT contains(line, 'Logical unit:') AND NOT contains(line, 'Component:') AND NOT contains(line, 'Template Version') AND NOT contains(line, 'layer Core')),
    m AS (SELECT file_id, pos, array_to_string(w[3:], ' ') AS msg FROM w WHERE len(w) >= 3 AND regexp_matches(w[1], '^([0-9]{{6}}|[^/]*/[^/]*/[^/]*)$')),
    u AS (SELECT file_id, pos, trim(substr(line, 3)) AS msg FROM s WHERE pos <= 50 AND line LIKE '--%' AND length(line) > 15 AND NOT regexp_matches(trim(substr(line, 3)), '^[- ]*$') AND line NOT LIKE '%-----'
      AND regexp_matches(lower(line), 'added|created|updated|fixed|changed|removed|modified') AND file_id NOT IN (SELECT file_id FROM m WHERE length(msg) > 3)),
    a AS (SELECT * FROM m WHERE length(msg) > 3 UNION ALL SELECT * FROM u),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, lower(msg) ORDER BY pos) AS rn FROM a) WHERE rn = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM f),
    o AS (SELECT file_id, string_agg(msg, ' | ' ORDER BY pos) AS notes FROM k WHERE {_SAMPLED} GROUP BY file_id)
    SELECT files.file_id, coalesce(notes, '') AS notes FROM files LEFT JOIN o USING (file_id)"""
)
def changelog_lines(spark, d):
    return files(spark, d).select("file_id", F.array_join(extract.change_notes(F.col("content")), " | ").alias("notes"))


@register(
    f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT doc_id, string_agg(i, ',' ORDER BY i) AS positions FROM l WHERE {_SAMPLED} GROUP BY doc_id"""
)
def even_sample(spark, d):
    places = F.transform(text.lines(F.col("text")), lambda x, i: i)
    return read(spark, d, "documents").select("doc_id", F.array_join(text.evenly_spaced(places, 10).cast("array<string>"), ",").alias("positions"))


_EXCLUDED = "|".join(extract.EXCLUDED_PREFIXES)


@register(
    _LINES_CTE
    + f""", s AS (SELECT file_id, pos, upper(trim(line)) AS line FROM l),
    dcl AS (SELECT file_id, pos, regexp_extract(line, '^(PROCEDURE|FUNCTION)', 1) AS kind, regexp_extract(line, '^(?:PROCEDURE|FUNCTION)\\s+(\\w+)', 1) AS name FROM s WHERE regexp_matches(line, '^(PROCEDURE|FUNCTION)\\s+\\w')),
    fit AS (SELECT *, row_number() OVER (PARTITION BY file_id, lower(name) ORDER BY pos) AS rn FROM dcl
      WHERE NOT regexp_matches(rtrim(name, '_'), '^({_EXCLUDED})') AND rtrim(name, '_') NOT IN ({', '.join(repr(n) for n in extract.EXCLUDED_NAMES)})),
    c AS (SELECT file_id, pos, kind || ' ' || name AS entry, name LIKE '%\\_\\_\\_' ESCAPE '\\' AS private FROM fit WHERE rn = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY file_id, private ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY file_id, private) AS n, count(*) FILTER (private) OVER (PARTITION BY file_id) AS npriv, count(*) FILTER (NOT private) OVER (PARTITION BY file_id) AS npub FROM c),
    w AS (SELECT *, CASE WHEN npub = 0 OR npriv = 0 THEN 10 WHEN private THEN least(10 - least(5, npub), npriv) ELSE CASE WHEN npriv < 10 - least(5, npub) THEN least(10 - npriv, npub) ELSE least(5, npub) END END AS want FROM k),
    p AS (SELECT * FROM w WHERE CASE WHEN npub = 0 OR npriv = 0 THEN i < 10 ELSE want >= n OR i = 0 OR (want > 1 AND i = n - 1) OR (want > 2 AND i IN (SELECT CAST(floor(1 + (n - 2.0) / (least(want - 2, n - 2) + 1) * g) AS BIGINT) FROM range(1, 9) r(g) WHERE g <= least(want - 2, n - 2))) END),
    o AS (SELECT *, row_number() OVER (PARTITION BY file_id, private ORDER BY pos) AS j, least(count(*) FILTER (private) OVER (PARTITION BY file_id), count(*) FILTER (NOT private) OVER (PARTITION BY file_id)) AS pairs FROM p),
    z AS (SELECT file_id, string_agg(entry, ',' ORDER BY CASE WHEN j <= pairs THEN 0 ELSE 1 END, j, private) AS names FROM o GROUP BY file_id)
    SELECT files.file_id, coalesce(names, '') AS names FROM files LEFT JOIN z USING (file_id)"""
)
def procedure_names_balanced(spark, d):
    return files(spark, d).select("file_id", F.array_join(extract.declared_names(F.col("content")), ",").alias("names"))


@register(
    _LINES_CTE
    + """, h AS (SELECT file_id, pos, trim(line) AS t FROM l WHERE pos <= 100),
    c AS (SELECT file_id, pos, CASE WHEN t LIKE '--%' AND length(t) > 5 THEN 1 WHEN contains(upper(t), 'PROCEDURE') THEN 2 WHEN contains(upper(t), 'FUNCTION') THEN 3 END AS k, CASE WHEN t LIKE '--%' AND length(t) > 5 THEN trim(substr(t, 3)) ELSE t END AS t FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_id, k ORDER BY pos) AS rn FROM c WHERE k IS NOT NULL),
    g AS (SELECT file_id, k, CASE k WHEN 1 THEN 'Comments: ' WHEN 2 THEN 'Procedures: ' ELSE 'Functions: ' END || string_agg(t, ' | ' ORDER BY pos) AS part FROM r WHERE rn <= 3 GROUP BY file_id, k)
    SELECT file_id, left(string_agg(part, ' | ' ORDER BY k), 2000) AS excerpt FROM g GROUP BY file_id"""
)
def content_excerpt(spark, d):
    return files(spark, d).select("file_id", extract.excerpt(F.col("content")).alias("excerpt"))


_SIGNALS = (
    _LINES_CTE
    + """, s AS (SELECT file_id, pos, line, trim(line) AS b, upper(trim(line)) AS u, contains(line, '*/') AS closes, contains(line, '/*') AS opens FROM l),
    o AS (SELECT *, coalesce(last_value(CASE WHEN closes THEN FALSE WHEN opens THEN TRUE END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING), FALSE) AS open FROM s),
    c AS (SELECT *, CASE WHEN closes THEN CASE WHEN b LIKE '--%' THEN 'comments' ELSE 'none' END
      WHEN contains(line, 'Error_SYS.Record_General') OR contains(line, 'Error_SYS.Appl_General') OR contains(u, 'RAISE_APPLICATION_ERROR') OR (contains(u, 'RAISE') AND (contains(u, 'EXCEPTION') OR contains(line, '-20'))) THEN 'error_messages'
      WHEN u LIKE 'PROCEDURE %' OR (contains(u, 'PROCEDURE ') AND (contains(u, 'AS') OR contains(u, 'BEGIN'))) THEN 'procedures'
      WHEN u LIKE 'FUNCTION %' OR (contains(u, 'FUNCTION ') AND (contains(u, 'RETURN') OR contains(u, 'AS'))) THEN 'functions'
      WHEN b LIKE '--%' OR open THEN 'comments' WHEN contains(line, '_API.') AND u NOT LIKE 'PACKAGE%' THEN 'api_calls'
      WHEN regexp_matches(u, 'SELECT|INSERT|UPDATE|DELETE|FROM |INTO ') THEN 'database_operations' ELSE 'body' END AS class FROM o),
    k AS (SELECT *, count(*) FILTER (class IN ('procedures', 'functions')) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block,
      last_value(CASE WHEN class IN ('procedures', 'functions') THEN class END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS kind FROM c),
    n AS (SELECT *, count(*) FILTER (class IN ('procedures', 'functions', 'body')) OVER (PARTITION BY file_id, block ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM k),
    sig AS (SELECT file_id, pos, CASE WHEN class IN ('procedures', 'functions', 'body') THEN CASE WHEN block > 0 AND nth <= 50 THEN kind END WHEN class <> 'none' THEN class END AS signal,
      CASE WHEN class IN ('error_messages', 'api_calls', 'database_operations') THEN b ELSE line END AS line FROM n)"""
)


@register(_SIGNALS + " SELECT file_id, pos - 1 AS pos, signal, line FROM sig WHERE signal IS NOT NULL")
def signal_classes(spark, d):
    return signals.signal_lines(files(spark, d)).select("file_id", F.col("pos").cast("long").alias("pos"), "signal", "line")


_BUDGET = 400
_CUTS = "CASE signal " + " ".join(f"WHEN '{s}' THEN {int(_BUDGET * p) * 4}" for s, p in signals.SHARES.items()) + " END"
_ORDER = "CASE signal " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(signals.SHARES)) + " END"


@register(
    _SIGNALS
    + f""", g AS (SELECT file_id, signal, string_agg(line, chr(10) ORDER BY pos) AS t, {_CUTS} AS m FROM sig WHERE signal IS NOT NULL GROUP BY file_id, signal),
    x AS (SELECT *, left(t, m) AS cut, length(left(t, m)) - instr(reverse(left(t, m)), chr(10)) AS last FROM g),
    y AS (SELECT file_id, signal, CASE WHEN length(t) > m THEN CASE WHEN contains(cut, chr(10)) AND last > m * 0.8 THEN left(cut, last) ELSE cut END ELSE t END AS t FROM x)
    SELECT file_id, string_agg(chr(10) || '--- ' || upper(replace(signal, '_', ' ')) || ' ---' || chr(10) || t, chr(10) ORDER BY {_ORDER}) AS balanced FROM y WHERE trim(t) <> '' GROUP BY file_id"""
)
def balanced_budget(spark, d):
    return signals.balanced(signals.signal_lines(files(spark, d)), _BUDGET)


@register(
    _LINES_CTE
    + """, s AS (SELECT file_id, pos, trim(line) AS t FROM l),
    k AS (SELECT file_id, pos, CASE WHEN t IN ('', '--', '/*', '*/') THEN NULL WHEN t LIKE '--%' THEN CASE WHEN length(trim(substr(t, 3))) > 3 AND trim(substr(t, 3)) NOT LIKE '====%' THEN trim(substr(t, 3)) END
      WHEN t LIKE '/*%' AND t LIKE '%*/' THEN CASE WHEN length(trim(substr(t, 3, length(t) - 4))) > 3 THEN trim(substr(t, 3, length(t) - 4)) END ELSE CASE WHEN length(regexp_replace(t, '\\s+', ' ', 'g')) > 2 THEN regexp_replace(t, '\\s+', ' ', 'g') END END AS t FROM s),
    j AS (SELECT file_id, string_agg(t, ' ' ORDER BY pos) AS t FROM k WHERE t IS NOT NULL GROUP BY file_id),
    p AS (SELECT file_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[(){}\\[\\];,]', ' ', 'g'), '[=<>!]+', ' ', 'g'), '[-+*/%&|^~]', ' ', 'g'), '[''"`]', ' ', 'g'), '[:@#$]', ' ', 'g') AS t FROM j),
    q AS (SELECT file_id, regexp_replace(regexp_replace(regexp_replace(t, '\\.(\\s|$)', ' \\1', 'g'), '(\\s)\\.', '\\1 ', 'g'), '[^\\p{L}\\p{N}_\\s.-]', ' ', 'g') AS t FROM p)
    SELECT file_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS cleaned FROM q"""
)
def clean_text(spark, d):
    return files(spark, d).select("file_id", text.clean_source(F.col("content")).alias("cleaned"))


_DESCRIBED = FILES_CTE + f", a AS (SELECT p_partkey AS file_id, upper(concat({_name('p_partkey', True)}, '_API')) AS api_key FROM part), x AS (SELECT file_id, unnest(list_distinct(list_transform(regexp_extract_all(content, '(?i)([A-Z][A-Z0-9_]*_API)\\.', 1), lambda x: upper(x)))) AS api_key FROM files), dim AS (SELECT api_key, arg_max(relative_path, file_id) AS dst FROM a JOIN files USING (file_id) GROUP BY api_key)"


@register(_DESCRIBED + " SELECT DISTINCT f.relative_path AS src, dst FROM x JOIN files f USING (file_id) JOIN dim USING (api_key) WHERE f.relative_path <> dst")
def resolved_calls(spark, d):
    return graph.reference_edges(described(spark, d))


@register("SELECT p_type AS api_name, max(p_partkey) AS path FROM part GROUP BY p_type")
def last_wins_dim(spark, d):
    rows = read(spark, d, "part").select(F.col("p_type").alias("api_name"), F.col("p_partkey").alias("relative_path"), F.col("p_partkey").alias("file_order"))
    return graph.last_by_name(rows).select(F.col("api_key").alias("api_name"), "path")


# --- the call graph of orders ---------------------------------------------------------------------------------------------


def call_edges(spark, d, forward: bool = False) -> DataFrame:
    """Part at line k calls the part at line k + 1 of the order."""
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    edges = items.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").where("src < dst" if forward else "src <> dst")
    return edges.distinct()


def part_nodes(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("node"))


_EDGES = "e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"
_FORWARD = _EDGES.replace("<> b", "< b")


@register(f"WITH {_EDGES} SELECT src, dst FROM e")
def reference_edges(spark, d):
    return call_edges(spark, d)


@register(f"WITH {_FORWARD}, c AS (SELECT p_partkey AS node, count(src) AS reference_count FROM part LEFT JOIN e ON dst = p_partkey GROUP BY 1) SELECT node, reference_count, row_number() OVER (ORDER BY reference_count DESC, node)::INT AS rank FROM c")
def in_degree_rank(spark, d):
    return graph.ranked(graph.in_degrees(part_nodes(spark, d), call_edges(spark, d, True)), "reference_count")


@register(f"WITH {_EDGES}, c AS (SELECT p_partkey AS node, count(src) AS reference_count FROM part LEFT JOIN e ON dst = p_partkey GROUP BY 1) SELECT node, reference_count, row_number() OVER (ORDER BY reference_count DESC, node)::INT AS rank FROM c")
def in_degree_rank_whole(spark, d):
    """in_degree_rank over all calls."""
    return graph.ranked(graph.in_degrees(part_nodes(spark, d), call_edges(spark, d)), "reference_count")


@register(f"WITH {_FORWARD} SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT dst FROM e)) AS no_incoming, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT src FROM e)) AS no_outgoing")
def no_in_out_links(spark, d):
    return graph.unlinked(part_nodes(spark, d), call_edges(spark, d, True))


_STEPS = ", n AS (SELECT count(*) AS n FROM part), o AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM e), r0 AS (SELECT p_partkey AS node, 1.0::DOUBLE / n AS score FROM part, n)" + "".join(
    f", r{i} AS (SELECT p_partkey AS node, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * coalesce(sum(score * share), 0) AS score FROM part CROSS JOIN n LEFT JOIN o ON dst = p_partkey LEFT JOIN r{i - 1} ON r{i - 1}.node = src GROUP BY p_partkey)" for i in range(1, 11)
)
_RANKS, _RANKS_WHOLE = f"WITH {_FORWARD}{_STEPS}", f"WITH {_EDGES}{_STEPS}"


@register(_RANKS + " SELECT node, round(score, 9) AS score FROM r10")
def pagerank_10_iters(spark, d):
    scores = graph.pagerank(part_nodes(spark, d), call_edges(spark, d, True), iterations=10, tolerance=None)
    return scores.select("node", F.round("score", 9).alias("score"))


@register(_RANKS_WHOLE + " SELECT node, round(score, 9) AS score FROM r10")
def pagerank_10_iters_whole(spark, d):
    """pagerank_10_iters over all calls: cycles, and no mass lost."""
    scores = graph.pagerank(part_nodes(spark, d), call_edges(spark, d), iterations=10, tolerance=None)
    return scores.select("node", F.round("score", 9).alias("score"))


@register(None)
def pagerank_converged(spark, d):
    return graph.ranked(graph.pagerank(part_nodes(spark, d), call_edges(spark, d)), "score")


# --- vectors and fusion ---------------------------------------------------------------------------------------------------

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@register(f"SELECT a.vec_id, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 7 AND a.vec_id <> 7 ORDER BY {_DOT} DESC, a.vec_id LIMIT 10")
def vector_top10(spark, d):
    return vector.search_like(read(spark, d, "embeddings"), 7, 10).select("vec_id", F.round("score", 6).alias("score"))


@register("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 GROUP BY 1 ORDER BY n DESC, dim LIMIT 1")
def dim_mode(spark, d):
    return vector.dimension_mode(read(spark, d, "embeddings")).select(F.col("dim").cast("long").alias("dim"), "n")


@register("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(embedding[64]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last FROM embeddings")
def l2_normalise(spark, d):
    return vector.build(read(spark, d, "embeddings")).select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.element_at("embedding", 64), 6).alias("last"))


def _hits(spark, d, k: int = 20) -> tuple[DataFrame, DataFrame]:
    lex = lexical.scan_search(tokens(spark, d), QUERY_TERMS, k)
    vec = vector.search_like(read(spark, d, "embeddings"), 7, k)
    shape = lambda df, key, source, match: df.select(F.col(key).alias("path"), "score", F.lit(source).alias("source"), F.lit(match).alias("match_type"))
    return shape(lex, "doc_id", "lexical", "exact"), shape(vec, "vec_id", "vector", "semantic")


_HITS = f"""WITH {_TOKENS}, q AS (SELECT unnest({QUERY_TERMS}) AS term), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
    p AS (SELECT doc_id, len(tokens) AS dl, term, len(list_filter(tokens, lambda x: x = term)) AS tf FROM t, q),
    f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM p GROUP BY term),
    lex AS (SELECT doc_id AS path, sum({_BM25}) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 20),
    vec AS (SELECT a.vec_id AS path, {_DOT} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 7 AND a.vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 20)"""
_MERGED = "m AS (SELECT path, CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN (a.score + b.score) / 2 ELSE coalesce(a.score, b.score) END AS score, CASE WHEN a.score IS NOT NULL AND b.score IS NOT NULL THEN 'hybrid' WHEN a.score IS NOT NULL THEN 'lexical' ELSE 'vector' END AS source FROM {a} a FULL JOIN {b} b USING (path))"


@register(_HITS + ", " + _MERGED.format(a="lex", b="vec") + " SELECT path, round(score, 6) AS score, source FROM m")
def hybrid_fusion(spark, d):
    return fusion.merged(*_hits(spark, d)).select("path", F.round("score", 6).alias("score"), "source")


@register(_HITS + ", l5 AS (SELECT * FROM lex ORDER BY score DESC, path LIMIT 3), v5 AS (SELECT * FROM vec ORDER BY score DESC, path LIMIT 7), " + _MERGED.format(a="l5", b="v5") + ", k AS (SELECT * FROM m ORDER BY score DESC, path LIMIT 8) SELECT path, round(score, 6) AS score, source FROM k WHERE score >= 0.3")
def hybrid_quota(spark, d):
    a, b = fusion.quotas(*query.WEIGHTS["semantic"], 10)
    lex, vec = _hits(spark, d)
    return fusion.cut(fusion.merged(fusion.take(lex, a), fusion.take(vec, b)), 8, 0.3).select("path", F.round("score", 6).alias("score"), "source")


@register(_HITS + ", a AS (SELECT path, score / (SELECT max(score) FROM lex) * 0.3::DOUBLE AS x FROM lex), b AS (SELECT path, score / (SELECT max(score) FROM vec) * 0.7::DOUBLE AS y FROM vec) SELECT path, round(CASE WHEN x IS NULL THEN y ELSE x + 0.5::DOUBLE * coalesce(y, 0) END, 6) AS score, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 'hybrid' WHEN x IS NOT NULL THEN 'lexical' ELSE 'vector' END AS source FROM a FULL JOIN b USING (path)")
def weighted_fusion(spark, d):
    return fusion.combined(*_hits(spark, d), *query.WEIGHTS["semantic"]).select("path", F.round("score", 6).alias("score"), "source")


_BOOST = _RANKS.replace("WITH ", "", 1)


@register(_HITS + ", " + _BOOST + " SELECT path, round(lex.score * (1 + coalesce(least(1, greatest(0, r10.score * 100)), 0)), 6) AS score FROM lex LEFT JOIN r10 ON node = path")
def pagerank_boost(spark, d):
    scores = graph.pagerank(part_nodes(spark, d), call_edges(spark, d, True), iterations=10, tolerance=None)
    ranks = scores.select(F.col("node").alias("relative_path"), F.col("node").alias("file_path"), (F.col("score") * 100).alias("pagerank_score"))
    return fusion.boosted(_hits(spark, d)[0], fusion.importance(ranks)).select("path", F.round("score", 6).alias("score"))


@register(_HITS + ", " + _RANKS_WHOLE.replace("WITH ", "", 1) + " SELECT path, round(lex.score * (1 + coalesce(least(1, greatest(0, r10.score * 100)), 0)), 6) AS score FROM lex LEFT JOIN r10 ON node = path")
def pagerank_boost_whole(spark, d):
    """pagerank_boost with the scores over all calls."""
    scores = graph.pagerank(part_nodes(spark, d), call_edges(spark, d), iterations=10, tolerance=None)
    ranks = scores.select(F.col("node").alias("relative_path"), F.col("node").alias("file_path"), (F.col("score") * 100).alias("pagerank_score"))
    return fusion.boosted(_hits(spark, d)[0], fusion.importance(ranks)).select("path", F.round("score", 6).alias("score"))


# --- processing logs and versions -----------------------------------------------------------------------------------------


@register(
    """WITH a AS (SELECT doc_id AS path, n_chars AS v FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT user_id AS path, arg_max(event_type, event_id) AS summary FROM events WHERE event_type <> 'click' GROUP BY 1),
    c AS (SELECT vec_id AS path, len(embedding) AS dim FROM embeddings WHERE vec_id % 2 = 0)
    SELECT path, v AS size, summary, dim FROM (SELECT path, v, summary FROM a FULL JOIN b USING (path)) LEFT JOIN c USING (path)"""
)
def phase_merge(spark, d):
    first = read(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("seq"))
    second = read(spark, d, "events").where("event_type <> 'click'").select(F.col("user_id").alias("path"), F.col("event_type").alias("summary"), F.col("event_id").alias("seq"))
    third = read(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("path"), F.size("embedding").cast("long").alias("dim"), F.lit(0).cast("long").alias("seq"))
    return phases.merge(first, second, third)


@register(
    """WITH b AS (SELECT user_id AS path, arg_max(event_type, event_id) AS summary FROM events GROUP BY 1)
    SELECT path, n_chars AS size, summary, len(embedding) AS dim FROM (SELECT doc_id AS path, n_chars FROM documents) FULL JOIN b USING (path) LEFT JOIN (SELECT vec_id AS path, embedding FROM embeddings) USING (path)"""
)
def phase_merge_whole(spark, d):
    """phase_merge over all rows; the gaps are those of the tables: not every document has events or an embedding."""
    first = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("seq"))
    second = read(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("summary"), F.col("event_id").alias("seq"))
    third = read(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.size("embedding").cast("long").alias("dim"), F.lit(0).cast("long").alias("seq"))
    return phases.merge(first, second, third)


@register("SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark, d):
    done = read(spark, d, "labels").select(F.col("doc_id").alias("path"), (F.col("quality") == 1).alias("success"))
    return phases.pending(read(spark, d, "documents").select(F.col("doc_id").alias("path")), done)


@register(
    """SELECT user_id AS run, count(*) AS files_processed, count(*) FILTER (event_type <> 'error') AS files_successful, count(*) FILTER (event_type = 'error') AS files_failed,
    round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1000000.0), 6) AS current_rate, round(count(*) FILTER (event_type <> 'error') / greatest(1, count(*))::DOUBLE, 6) AS success_rate
    FROM events GROUP BY 1 HAVING max(ts) > min(ts)"""
)
def progress_stats(spark, d):
    log = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("timestamp"), (F.col("event_type") != "error").alias("success"))
    out = phases.progress(log, total=None)
    return out.where("total_processing_time > 0").select("run", "files_processed", "files_successful", "files_failed", F.round("current_rate", 6).alias("current_rate"), F.round("success_rate", 6).alias("success_rate"))


@register("SELECT doc_id AS version, doc_id IN (SELECT doc_id FROM labels) AS has_lexical, doc_id IN (SELECT vec_id FROM embeddings) AS has_vectors, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS has_pagerank, doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_ready FROM documents")
def readiness_flags(spark, d):
    labels = read(spark, d, "labels")
    versions = read(spark, d, "documents").select(F.col("doc_id").alias("version"))
    key = lambda df, c: df.select(F.col(c).alias("version")).distinct()
    return phases.readiness(versions, lexical=key(labels, "doc_id"), vectors=key(read(spark, d, "embeddings"), "vec_id"), pagerank=key(labels.where("toxic = 1"), "doc_id"))


@register("SELECT r_name, count(*) AS n_suppliers, count(DISTINCT n_name) AS n_nations, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def module_distribution(spark, d):
    rows = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count("*").alias("n_suppliers"), F.countDistinct("n_name").alias("n_nations"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


@register("SELECT p_partkey, p_name, p_type FROM part WHERE upper(p_name) LIKE '%RING%' AND p_type IN (SELECT p_type FROM part WHERE p_size > 45) ORDER BY p_name, p_partkey LIMIT 25")
def like_search(spark, d):
    part = read(spark, d, "part")
    types = part.where("p_size > 45").select("p_type").distinct()
    return part.where("upper(p_name) like '%RING%'").join(types, "p_type", "left_semi").select("p_partkey", "p_name", "p_type").orderBy("p_name", "p_partkey").limit(25)


@register("SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Partial' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def case_status(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "Finished").when(F.col("o_orderstatus") == "O", "Open").otherwise("Partial")
    return read(spark, d, "orders").groupBy("o_orderpriority", status.alias("status")).agg(F.count("*").alias("n"))


@register("SELECT doc_id, regexp_replace(source || ' v1.' || doc_id || '/x', '[^A-Za-z0-9._-]', '', 'g') AS version FROM documents")
def version_names(spark, d):
    return read(spark, d, "documents").select("doc_id", text.safe_version(F.concat("source", F.lit(" v1."), F.col("doc_id").cast("string"), F.lit("/x"))).alias("version"))


@register("SELECT tag, asset, user_id FROM (SELECT 'v' || (user_id % 9) AS tag, min(event_type) AS asset, min(user_id) AS user_id FROM events GROUP BY user_id % 9 HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'view') > 0 ORDER BY min(event_id) LIMIT 1)")
def first_complete_release(spark, d):
    events = read(spark, d, "events").withColumn("tag", F.concat(F.lit("v"), (F.col("user_id") % 9).cast("string")))
    both = events.groupBy("tag").agg(F.min("event_type").alias("asset"), F.min("user_id").alias("user_id"), F.min("event_id").alias("at"), F.max(F.col("event_type") == "click").alias("a"), F.max(F.col("event_type") == "view").alias("b"))
    return both.where("a and b").orderBy("at").limit(1).select("tag", "asset", "user_id")


@register(None)
def incremental_reindex(spark, d):
    """Token counts by a file stream over documents, run until nothing is left, then read back from its table."""
    import uuid

    from .storage import scratch_root
    from .streaming.incremental import process_new

    root = f"{scratch_root(spark)}/lodestar-stream-{uuid.uuid4().hex}"
    schema = read(spark, d, "documents").schema
    counted = lambda df: df.select("doc_id", F.size(text.basic_tokens(F.col("text"))).cast("long").alias("n_tokens"))
    process_new(spark, f"{d}/documents.parquet*", schema, counted, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table").select("doc_id", "n_tokens")


ORACLES["incremental_reindex"] = "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n_tokens FROM documents"


@register(None)
def rerank_standin(spark, d):
    """The best documents for a query, rescored by a stand-in reranker that reads their whole texts. The 20 hits are
    broadcast and only they move to the reranker's task; the documents are scanned where they lie."""
    from . import models

    docs = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("passage"))
    hits = docs.join(F.broadcast(_hits(spark, d, 20)[0]), "path").repartition(1)
    return models.rerank(hits, " ".join(QUERY_TERMS), "passage", models.overlap_reranker).select("path", "score", "source")


@register("SELECT event_type, time_bucket(INTERVAL 5 MINUTES, ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """EXTENSION: windowed counts; the same plan runs on a stream."""
    from .streaming.incremental import event_counts

    out = event_counts(read(spark, d, "events"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 4).alias("value"))
