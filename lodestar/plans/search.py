"""Hybrid search end to end: analyse, retrieve, boost, quota, merge, rerank, cut, explain."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import basic_tokens
from ..models import Embedder, Reranker, rerank
from ..operators import fusion, lexical, query, vector


@dataclass(frozen=True)
class SearchConfig:
    preset_name: str = ""
    enable_vectors: bool = True
    enable_rerank: bool = True
    fetch_multiplier: int = 2
    min_score_threshold: float = 0.0

    @classmethod
    def fast_hardware(cls) -> SearchConfig:
        return cls("fast_hardware", True, True, 4)

    @classmethod
    def medium_hardware(cls) -> SearchConfig:
        return cls("medium_hardware", True, False, 2)

    @classmethod
    def slow_hardware(cls) -> SearchConfig:
        return cls("slow_hardware", False, False, 1)


@dataclass
class SearchResponse:
    query: str
    query_type: str
    results: DataFrame
    total_found: int
    search_time: float
    fusion_method: str
    lexical_count: int
    vector_count: int
    rerank_applied: bool
    suggestions: list[str] = field(default_factory=list)
    search_config: SearchConfig | None = None

    def markdown(self) -> str:
        """The results as Markdown, for people."""
        rows = self.results.collect()
        if not rows:
            return f"No results for: {self.query}"
        out = [f"# {len(rows)} results for: {self.query}", f"type {self.query_type}, method {self.fusion_method}, {self.search_time:.2f} s", ""]
        for i, r in enumerate(rows, 1):
            out += [f"## {i}. {r.title}", f"- path: `{r.path}`", f"- score: {r.score:.4f} ({r.source})", f"- {r.explanation}", f"> {r.snippet}", ""]
        return "\n".join(out)


class HybridSearch:
    """Search over written tables. What a query finds is at most a few times top_k rows, which are kept as local rows;
    nothing is cached, and the documents' text is read for hits only. Parts are optional: without vectors, an embedder or a reranker the others still work.

    docs: path, file_name, api_name, rank, content; index: LexicalIndex whose doc_id is the path; vectors: vec_id (the
    path), embedding (normalised); ranks: relative_path, file_path, pagerank_score."""

    def __init__(self, docs: DataFrame, index: lexical.LexicalIndex, vectors: DataFrame | None = None, ranks: DataFrame | None = None, embedder: Callable[[], Embedder] | None = None, reranker: Callable[[], Reranker] | None = None, tokens=basic_tokens) -> None:
        self.docs, self.index, self.vectors, self.embedder, self.reranker, self.tokens = docs, index, vectors, embedder, reranker, tokens
        self.boosts = fusion.importance(ranks) if ranks is not None else None
        self.spark = docs.sparkSession
        self._embed: Embedder | None = None
        self._asked: dict[str, list[float]] = {}  # the vectors of the last queries

    def stats(self) -> dict[str, int | bool]:
        """What is loaded."""
        return {"lexical_documents": self.index.docs.count(), "vectors": self.vectors.count() if self.vectors is not None else 0, "cached_queries": len(self._asked), "initialised": self.vectors is not None and self.embedder is not None and self.reranker is not None}

    def _vector(self, q: str, most: int = 256) -> list[float]:
        """The query's vector; those of the last queries are kept."""
        if self._embed is None:
            self._embed = self.embedder()
        found = self._asked.pop(q, None)
        self._asked[q] = found if found is not None else self._embed([q])[0].tolist()
        if len(self._asked) > most:
            del self._asked[next(iter(self._asked))]
        return self._asked[q]

    def _described(self, hits: list[Row], q: str, source: str, match: str) -> DataFrame:
        """The hits, k rows on the driver, with what the documents say about them: the documents' table is read for
        their paths only, which its clustering turns into few row groups."""
        found = self.spark.createDataFrame([(r["path"], float(r["score"])) for r in hits], "path string, score double")
        docs = self.docs.where(F.col("path").isin(*[r["path"] for r in hits])) if hits else self.docs.limit(0)
        d = docs.join(F.broadcast(found), "path").withColumn("source", F.lit(source)).withColumn("match_type", F.lit(match))
        title = F.concat_ws(" - ", "api_name", "file_name")
        shown = d.select("path", "score", "source", "match_type", "file_name", "api_name", "rank", title.alias("title"), text.best_line(F.col("content"), text.query_words(F.lit(q))).alias("snippet"), F.concat(F.lit(source), F.lit(" match")).alias("explanation"))
        return self.spark.createDataFrame(shown.collect(), shown.schema)

    def _boosted(self, hits: DataFrame) -> DataFrame:
        """Hits, which are local rows, with the importance of their files; of other files nothing is read."""
        if self.boosts is None:
            return hits
        return fusion.boosted(hits, self.boosts.where(F.col("path").isin(*[r["path"] for r in hits.select("path").collect()])))

    def lexical_hits(self, q: str, k: int) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(0).alias("query_id"), self.tokens(F.lit(q)).alias("terms"))
        hits = lexical.search_batch(self.index, asked, k).select(F.col("doc_id").alias("path"), "score")
        return self._described(hits.collect(), q, "lexical", "exact")

    def vector_hits(self, q: str, k: int) -> DataFrame | None:
        if self.vectors is None or self.embedder is None or not q:
            return None
        hits = vector.search(self.vectors, self._vector(q), k).select(F.col("vec_id").alias("path"), "score")
        return self._described(hits.collect(), q, "vector", "semantic")

    def search(self, q: str | None = None, semantic: str | None = None, lexical_query: str | None = None, top_k: int = 10, config: SearchConfig | None = None, explain: bool = True, fill_quota: bool = False) -> SearchResponse:
        """One query serves both sides; a missing special query is filled from the other one. With fill_quota, places
        that one side leaves empty go to the other."""
        began, config = time.time(), config or SearchConfig()
        semantic = semantic if semantic is not None else (q if q is not None else lexical_query)
        lexical_query = lexical_query if lexical_query is not None else (q if q is not None else semantic)
        if semantic is None:
            raise ValueError("a query is needed")
        primary = q if q is not None else semantic
        analysis = query.analyse(primary)
        fetch = top_k * config.fetch_multiplier
        lex = self.lexical_hits(lexical_query, fetch)
        vec = self.vector_hits(semantic, fetch) if config.enable_vectors else None
        vec = vec if vec is not None else lex.limit(0)
        n_lex, n_vec = lex.count(), vec.count()
        a, b = fusion.quotas(analysis.lexical_weight, analysis.vector_weight, top_k) if config.enable_vectors else (top_k, 0)
        if fill_quota:
            a, b = max(a, top_k - min(b, n_vec)), max(b, top_k - min(a, n_lex))
        merged = fusion.merged(fusion.take(self._boosted(lex), a), fusion.take(self._boosted(vec), b))
        rows = merged.collect()  # at most top_k
        merged, total = self.spark.createDataFrame(rows, merged.schema), len(rows)
        applied = config.enable_rerank and self.reranker is not None and total > 1
        found = merged
        if applied:
            asked = merged.withColumn("_passage", fusion.passage(F.col("api_name"), F.col("title"), F.col("snippet")))
            found = rerank(asked, semantic, "_passage", self.reranker).drop("_passage")
        found = fusion.cut(found, top_k, config.min_score_threshold)
        if explain:
            found = fusion.explained(found)
        how = ("reranked" if applied else "weighted") if config.enable_vectors else ("lexical_reranked" if applied else "lexical_only")
        return SearchResponse(primary, analysis.type, found.orderBy(F.desc("score"), "path"), total, time.time() - began, f"pagerank_{how}", n_lex, n_vec, applied, analysis.expansions, config)
