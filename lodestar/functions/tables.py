"""Table functions for SQL: a deployment's tokenizer, embedder, summariser and reranker over any table.

    tables.register(spark, embedder=my_embedder)
    SELECT * FROM lodestar_embed(TABLE(SELECT path AS key, summary AS text FROM files))
    SELECT * FROM lodestar_rerank(t => TABLE(hits) PARTITION BY query_id, k => 10)

The functions take Arrow batches and hold what one batch needs, and lodestar_rerank the k best rows of its partition
besides; a partition of any size streams through. A model is made once per Python worker, by a factory, as everywhere."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .. import models

Tokenizer = Callable[[str], list[str]]


@cache
def _loaded(make: Callable) -> Callable:
    return make()


def word_tokenizer() -> Tokenizer:
    """The search tokens of a text: words of letters, digits and underscores, lower-cased."""
    import regex

    words = regex.compile(r"[\p{L}\p{N}_]+")
    return lambda text: [w.lower() for w in words.findall(text)]


def _strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch[name].cast(pa.string()).to_pylist()


def tokens(make: Callable[[], Tokenizer]):
    """(key, text) to (key, pos, token), a row a token in order; a null text has none."""

    @arrow_udtf(returnType="key string, pos int, token string")
    class Tokens:
        def eval(self, t: pa.RecordBatch) -> Iterator[pa.Table]:
            split = _loaded(make)
            for key, text in zip(_strings(t, "key"), _strings(t, "text"), strict=True):
                found = split(text or "")
                yield pa.table([pa.array([key] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["key", "pos", "token"])

    return Tokens


def embed(make: Callable[[], models.Embedder]):
    """(key, text) to (key, embedding); a null text is the empty one."""

    @arrow_udtf(returnType="key string, embedding array<float>")
    class Embed:
        def eval(self, t: pa.RecordBatch) -> Iterator[pa.Table]:
            vectors = _loaded(make)([x or "" for x in _strings(t, "text")])
            yield pa.table([t["key"].cast(pa.string()), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], ["key", "embedding"])

    return Embed


def summarise(make: Callable[[], models.Summariser]):
    """(key, text) to (key, summary, error); where a batch fails its texts are tried one by one, and those that fail
    again keep their error."""

    @arrow_udtf(returnType="key string, summary string, error string")
    class Summarise:
        def eval(self, t: pa.RecordBatch) -> Iterator[pa.Table]:
            model, texts, found = _loaded(make), [x or "" for x in _strings(t, "text")], []
            try:
                found = [(s, None) for s in model(texts)]
            except Exception:
                for x in texts:
                    try:
                        found.append((model([x])[0], None))
                    except Exception as e:
                        found.append((None, str(e)))
            yield pa.table([t["key"].cast(pa.string()), *[pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]], ["key", "summary", "error"])

    return Summarise


class _Entry:
    """A hit in a heap whose first is the worst: the lower score, of equal ones the greater key."""

    def __init__(self, score: float, key: str) -> None:
        self.score, self.key = score, key

    def __lt__(self, other: _Entry) -> bool:
        return (self.score, other.key) < (other.score, self.key)


def rerank(make: Callable[[], models.Reranker]):
    """(query_id, query, key, passage), partitioned by query_id, to the k best (query_id, key, score, place) of each
    query, ties by key; without k the 10 best. A null passage is the empty one."""

    @arrow_udtf(returnType="query_id string, key string, score double, place int")
    class Rerank:
        def __init__(self) -> None:
            self.query_id: str | None = None
            self.best: list[_Entry] = []

        def eval(self, t: pa.RecordBatch, k: pa.Array | None = None) -> Iterator[pa.Table]:
            if not t.num_rows:
                return iter(())
            most = k[0].as_py() if k is not None else 10
            self.query_id = _strings(t, "query_id")[0]
            scores = _loaded(make)(t["query"][0].as_py() or "", [p or "" for p in _strings(t, "passage")])
            for score, key in zip(scores, _strings(t, "key"), strict=True):
                entry = _Entry(float(score), key or "")
                if len(self.best) < most:
                    heapq.heappush(self.best, entry)
                elif most and self.best[0] < entry:
                    heapq.heapreplace(self.best, entry)
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if self.best:
                best = sorted(self.best, reverse=True)
                yield pa.table([pa.array([self.query_id] * len(best), pa.string()), pa.array([e.key for e in best]), pa.array([e.score for e in best]), pa.array(range(1, len(best) + 1), pa.int32())], ["query_id", "key", "score", "place"])

    return Rerank


def register(spark: SparkSession, tokenizer: Callable[[], Tokenizer] = word_tokenizer, embedder: Callable[[], models.Embedder] = models.hashing_embedder, summariser: Callable[[], models.Summariser] = models.first_line_summariser, reranker: Callable[[], models.Reranker] = models.overlap_reranker) -> None:
    """Make lodestar_tokens, lodestar_embed, lodestar_summarise and lodestar_rerank known to the session's SQL."""
    for name, made in (("tokens", tokens(tokenizer)), ("embed", embed(embedder)), ("summarise", summarise(summariser)), ("rerank", rerank(reranker))):
        spark.udtf.register(f"lodestar_{name}", made)
