"""The search tools: one query in, Markdown out. A server process keeps one HybridSearch open and calls these."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable

from .plans.search import HybridSearch, SearchConfig

class LazyEngine:
    """A search engine that is made when it is first needed, or some seconds after the start, whichever is earlier, so
    that a server answers its client's greeting at once. make() runs once; its error is raised at every use."""

    def __init__(self, make: Callable[[], HybridSearch], prewarm_after: float | None = 10.0) -> None:
        self._make, self._lock = make, threading.Lock()
        self._made: HybridSearch | None = None
        self._error: Exception | None = None
        self._timer = threading.Timer(prewarm_after, self._warm) if prewarm_after is not None else None
        if self._timer is not None:
            self._timer.daemon = True
            self._timer.start()

    def _warm(self) -> None:
        with contextlib.suppress(Exception):  # the first query raises it
            self.get()

    def get(self) -> HybridSearch:
        with self._lock:
            if self._made is None and self._error is None:
                try:
                    self._made = self._make()
                except Exception as e:
                    self._error = e
        if self._error is not None:
            raise self._error
        return self._made

    def close(self) -> None:
        if self._timer is not None:
            self._timer.cancel()


GUIDANCE = """# Working with search results
1. Start with a business term; the semantic side finds files by purpose.
2. Repeat with the exact package or procedure name; the lexical side finds declarations and calls.
3. Read the highest ranked file first: many others call it, so its conventions are the ones to follow.
4. Before changing a procedure, search its package name to see its callers.
"""


def search_codebase(engine: HybridSearch, query: str | None = None, semantic_query: str | None = None, lexical_query: str | None = None, search_mode: str = "hybrid", max_results: int = 10, explain_results: bool = True) -> str:
    """search_mode: hybrid, semantic or lexical."""
    if search_mode == "lexical":
        config, semantic_query, lexical_query = SearchConfig("lexical", False, False), None, lexical_query or query
    elif search_mode == "semantic":
        config, semantic_query = SearchConfig("semantic", True, True), semantic_query or query
    elif search_mode == "hybrid":
        config = SearchConfig.fast_hardware()
    else:
        return f"unknown search mode: {search_mode}"
    if not (query or semantic_query or lexical_query):
        return "a query is needed"
    return engine.search(query, semantic_query, lexical_query, max_results, config, explain_results).markdown()


def search_semantic(engine: HybridSearch, query: str, max_results: int = 10) -> str:
    return search_codebase(engine, query, search_mode="semantic", max_results=max_results)


def search_lexical(engine: HybridSearch, query: str, max_results: int = 10) -> str:
    return search_codebase(engine, query, search_mode="lexical", max_results=max_results)


def development_guidance() -> str:
    return GUIDANCE
