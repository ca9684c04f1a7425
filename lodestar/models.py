"""Extension points for models, and deterministic stand-ins.

A deployment passes its own embedder, reranker, summariser or tokenizer: plain callables over batches, made by a factory
on each executor so that a model is loaded once per Python worker. The stand-ins below need no files and are no match for
real models; they exist so that every plan can run and be tested offline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]
Reranker = Callable[[str, list[str]], list[float]]
Summariser = Callable[[list[str]], list[str]]


def hashing_embedder(dims: int = 64) -> Embedder:
    """STAND-IN: signed feature hashing of words, normalised. A text whose words cancel each other out is hashed without
    signs, so that every text with a word has a vector of length one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, t in zip(out, texts, strict=True):
            hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in t.lower().split()]
            for h in hashes:
                row[h % dims] += 1 if h >> 63 else -1
            if hashes and not row.any():
                for h in hashes:
                    row[h % dims] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def overlap_reranker() -> Reranker:
    """STAND-IN: the share of the query's words that a passage holds."""

    def score(query: str, passages: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(p.lower().split())) / max(1, len(wanted)) for p in passages]

    return score


def first_line_summariser() -> Summariser:
    """STAND-IN: the first line that is not blank."""
    return lambda texts: [next((x.strip() for x in t.split("\n") if x.strip()), "") for t in texts]


def embed(df: DataFrame, text: str, make: Callable[[], Embedder], out: str = "embedding") -> DataFrame:
    """df with an embedding column; batches of Arrow rows, one model per worker."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            pdf[out] = [v.tolist() for v in model(pdf[text].fillna("").tolist())]
            yield pdf

    return df.mapInPandas(f, schema)


def summarise(df: DataFrame, text: str, make: Callable[[], Summariser]) -> DataFrame:
    """df with summary, success, error_message and tokens_used; a row whose batch fails is tried alone, and keeps its
    error if it fails again."""
    added = [T.StructField("summary", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("error_message", T.StringType()), T.StructField("tokens_used", T.IntegerType())]
    schema = T.StructType([*df.schema.fields, *added])

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            results: list[tuple[str | None, str | None]] = []
            try:
                results = [(s, None) for s in model(texts)]
            except Exception:
                for t in texts:
                    try:
                        results.append((model([t])[0], None))
                    except Exception as e:  # the row keeps its error
                        results.append((None, str(e)))
            pdf["summary"] = [s for s, _ in results]
            pdf["success"] = [e is None for _, e in results]
            pdf["error_message"] = [e for _, e in results]
            pdf["tokens_used"] = pd.array([len(t) // 4 for t in texts], "int32")
            yield pdf

    return df.mapInPandas(f, schema)


def rerank(hits: DataFrame, query: str, passage: str, make: Callable[[], Reranker]) -> DataFrame:
    """hits with the reranker's scores, source marked as reranked. Hits are the few rows that fusion kept, so they go
    to one task, which scores them together; rows are matched by themselves, not by an id."""
    schema = hits.schema

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        pdf = pd.concat(parts) if parts else pd.DataFrame(columns=schema.names)
        if len(pdf) > 1:
            pdf["score"] = make()(query, pdf[passage].tolist())
            pdf["source"] = pdf["source"] + "+reranked"
        yield pdf

    return hits.coalesce(1).mapInPandas(f, schema)
