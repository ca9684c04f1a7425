"""Query analysis: the type of a query, its weights and its expansions, for one query or for a table of queries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.naming import camel_case
from ..functions.text import words

#: Patterns, searched without regard to case, phrases, weights (lexical, vector) and synonyms.
API_PATTERNS = (r"[A-Z_]+_API$", r"[A-Za-z]+API$", r"[A-Za-z_]+\.[A-Za-z_]+")
CODE_PATTERNS = (r"SELECT\s+.*FROM", r"PROCEDURE\s+\w+", r"FUNCTION\s+\w+", r"Error_SYS\.", r"RAISE_APPLICATION_ERROR")
PHRASES = ("how to", "what is", "why does", "business logic", "functionality", "purpose", "workflow", "process")
WEIGHTS = {"exact_match": (0.8, 0.2), "code_pattern": (0.7, 0.3), "semantic": (0.3, 0.7), "mixed": (0.5, 0.5)}
SYNONYMS = {
    "error": ("exception", "failure", "issue"),
    "create": ("insert", "add", "new"),
    "update": ("modify", "change", "edit"),
    "delete": ("remove", "drop"),
    "get": ("retrieve", "fetch", "select"),
}


@dataclass(frozen=True)
class Analysis:
    query: str
    type: str
    lexical_weight: float
    vector_weight: float
    tokens: list[str] = field(default_factory=list)
    expansions: list[str] = field(default_factory=list)


def analyse(query: str) -> Analysis:
    matches = lambda patterns: any(re.search(p, query, re.I) for p in patterns)
    if matches(API_PATTERNS) or query.isupper():
        kind = "exact_match"
    elif matches(CODE_PATTERNS):
        kind = "code_pattern"
    elif any(p in query.lower() for p in PHRASES):
        kind = "semantic"
    else:
        kind = "mixed"
    expansions = ["".join(w.capitalize() for w in query.split("_"))] if query.isupper() and "_" in query else []
    expansions += [s for w in query.lower().split() for s in SYNONYMS.get(w, ())]
    return Analysis(query, kind, *WEIGHTS[kind], query.split(), expansions[:3])


def query_type(q: Column) -> Column:
    """analyse().type of a column of queries."""
    found = lambda patterns: F.greatest(*[q.rlike(f"(?i){p}") for p in patterns])
    capitals = (q == F.upper(q)) & (q != F.lower(q))
    phrase = F.greatest(*[F.lower(q).contains(p) for p in PHRASES])
    return F.when(found(API_PATTERNS) | capitals, "exact_match").when(found(CODE_PATTERNS), "code_pattern").when(phrase, "semantic").otherwise("mixed")


def weights(kind: Column) -> tuple[Column, Column]:
    """Lexical and vector weight of a type."""
    return tuple(F.coalesce(*[F.when(kind == k, F.lit(w[i])) for k, w in WEIGHTS.items()]) for i in (0, 1))


def expansions(q: Column) -> Column:
    capitals = (q == F.upper(q)) & (q != F.lower(q)) & q.contains("_")
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    synonyms = F.flatten(F.filter(F.transform(words(F.lower(q)), lambda w: F.element_at(table, w)), lambda a: a.isNotNull()))
    return F.slice(F.concat(F.when(capitals, F.array(camel_case(q))).otherwise(F.array().cast("array<string>")), synonyms), 1, 3)
