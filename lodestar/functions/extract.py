"""What a source file declares and calls, as column expressions over its whole text: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import evenly_spaced, first_seen, let, lines, strip, words

#: Name prefixes of generated or framework methods.
EXCLUDED_PREFIXES = (
    "GET_ SET_ CHECK_INSERT_ CHECK_UPDATE_ CHECK_DELETE_ CHECK_COMMON_ DO_INSERT_ DO_UPDATE_ DO_DELETE_ DO_MODIFY_ DO_REMOVE_ IS_ HAS_ "
    "EXIST_ EXISTS_ VALIDATE_ VERIFY_ UNPACK_ PACK_ PREPARE_ FINISH_ COMPLETE_ NEW__ MODIFY__ REMOVE__ DELETE__ INSERT__ UPDATE__ PRE_ "
    "POST_ BEFORE_ AFTER_ GET_OBJSTATE GET_OBJVERSION GET_OBJID GET_STATE FINITE_STATE_ SET_STATE_ GET_DB_VALUES_ GET_CLIENT_VALUES_ "
    "DECODE_ ENCODE_ GET_KEY_BY_ GET_KEYS_BY_"
).split()
#: Framework methods by name.
EXCLUDED_NAMES = "GET_OBJKEY GET_VERSION_BY_KEYS GET_VERSION_BY_ID EXIST GET_FULL_NAME GET_DESCRIPTION GET_INFO GET_BY_KEYS LOCK__ NEW__ MODIFY__ REMOVE__ DELETE__".split()
#: Verbs by which a change note is recognised without a date.
CHANGE_VERBS = "added created updated fixed changed removed modified".split()
LIMIT = 10


def api_calls(content: Column) -> Column:
    """The distinct packages called, in capitals, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(content, F.lit(r"(?i)([A-Z][A-Z0-9_]*_API)\."), F.lit(1)), F.upper)))


def qualified_calls(content: Column, first: int = LIMIT) -> Column:
    """The first calls as package.method, repeated ones too."""
    pattern = F.lit(r"\b([A-Z][A-Za-z_]*_API)\.([A-Za-z_]+)\s*\(")
    pairs = F.zip_with(F.regexp_extract_all(content, pattern, F.lit(1)), F.regexp_extract_all(content, pattern, F.lit(2)), lambda a, b: F.concat_ws(".", a, b))
    return F.slice(pairs, 1, first)


def change_notes(content: Column) -> Column:
    """Up to ten messages of the change log in a file's head, evenly spaced; undated notes if there is none."""
    return let(F.transform(lines(content, 100), strip), _change_notes)


def _change_notes(head: Column) -> Column:
    dated = F.filter(
        head,
        lambda x: x.startswith("--")
        & (F.length(x) > 10)
        & ~strip(F.substring(x, 3, 2**31 - 1)).rlike("^[- ]*$")
        & ~(x.contains("Date") & x.contains("Sign") & x.contains("History"))
        & ~x.endswith("-")
        & ~x.contains("Logical unit:")
        & ~x.contains("Component:")
        & ~x.contains("Template Version")
        & ~x.contains("layer Core"),
    )
    parts = F.filter(F.transform(dated, lambda x: words(F.substring(x, 3, 2**31 - 1))), lambda w: (F.size(w) >= 3) & F.element_at(w, 1).rlike(r"^([0-9]{6}|[^/]*/[^/]*/[^/]*)$"))
    messages = F.filter(F.transform(parts, lambda w: F.array_join(F.slice(w, F.lit(3), F.size(w)), " ")), lambda m: F.length(m) > 3)
    body = lambda x: strip(F.substring(x, 3, 2**31 - 1))
    verbs = "|".join(CHANGE_VERBS)
    undated = F.filter(F.slice(head, 1, 50), lambda x: x.startswith("--") & (F.length(x) > 15) & ~body(x).rlike("^[- ]*$") & ~x.endswith("-----") & F.lower(body(x)).rlike(verbs))
    return let(messages, lambda found: evenly_spaced(first_seen(F.when(F.size(found) > 0, found).otherwise(F.transform(undated, body))), LIMIT))


def declared_names(content: Column) -> Column:
    """Up to ten declared procedures and functions, public and private (three underscores) ones in turn."""
    declared = F.filter(F.transform(lines(content), lambda x: F.upper(strip(x))), lambda x: x.rlike(r"(?U)^(PROCEDURE|FUNCTION)\s+\w"))
    kind = lambda x: F.regexp_extract(x, r"^(PROCEDURE|FUNCTION)", 1)
    name = lambda x: F.regexp_extract(x, r"(?U)^(?:PROCEDURE|FUNCTION)\s+(\w+)", 1)
    stem = lambda x: F.regexp_replace(name(x), "_+$", "")
    excluded = "^(" + "|".join(EXCLUDED_PREFIXES) + ")"
    fit = F.filter(declared, lambda x: ~stem(x).rlike(excluded) & ~stem(x).isin(*EXCLUDED_NAMES))
    entries = F.transform(first_seen(fit, lambda x: F.lower(name(x))), lambda x: F.concat_ws(" ", kind(x), name(x)))
    private, public = (lambda e: F.filter(e, lambda x: x.endswith("___"))), (lambda e: F.filter(e, lambda x: ~x.endswith("___")))
    return let(entries, lambda e: let(private(e), lambda a: let(public(e), lambda b: _balanced(b, a))))


def _balanced(public: Column, private: Column) -> Column:
    n_private, n_public = F.size(private), F.size(public)
    want_public = F.least(F.lit(LIMIT // 2), n_public)
    want_private = F.least(F.lit(LIMIT) - want_public, n_private)
    want_public = F.when(want_private < LIMIT - want_public, F.least(F.lit(LIMIT) - want_private, n_public)).otherwise(want_public)
    mixed = let(evenly_spaced(public, want_public), lambda a: let(evenly_spaced(private, want_private), lambda b: _in_turn(a, b)))
    return F.when(n_public == 0, F.slice(private, 1, LIMIT)).when(n_private == 0, F.slice(public, 1, LIMIT)).otherwise(F.slice(mixed, 1, LIMIT))


def _in_turn(a: Column, b: Column) -> Column:
    both = F.least(F.size(a), F.size(b))
    turns = F.flatten(F.zip_with(F.slice(a, F.lit(1), both), F.slice(b, F.lit(1), both), lambda x, y: F.array(x, y)))
    return F.concat(turns, F.slice(a, both + 1, F.size(a)), F.slice(b, both + 1, F.size(b)))


def excerpt(content: Column) -> Column:
    """Comments, procedures and functions of a file's head, up to three each; the first 1000 characters without any."""
    head = lines(content, 100)
    is_comment = lambda x: strip(x).startswith("--") & (F.length(strip(x)) > 5)
    is_procedure = lambda x: ~is_comment(x) & F.upper(x).contains("PROCEDURE")
    is_function = lambda x: ~is_comment(x) & ~F.upper(x).contains("PROCEDURE") & F.upper(x).contains("FUNCTION")

    def part(label: str, keep, text) -> Column:
        found = F.slice(F.filter(head, keep), 1, 3)
        return F.when(F.size(found) > 0, F.concat(F.lit(label), F.array_join(F.transform(found, text), " | ")))

    joined = F.concat_ws(" | ", part("Comments: ", is_comment, lambda x: strip(F.substring(strip(x), 3, 2**31 - 1))), part("Procedures: ", is_procedure, strip), part("Functions: ", is_function, strip))
    return F.substring(F.when(joined == "", F.substring(content, 1, 1000)).otherwise(joined), 1, 2000)


def lexical_text(tokens: Column, file_name: Column, api_name: Column, rank: Column, notes: Column, names: Column) -> Column:
    """The text that the lexical index holds for a file."""
    some = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(label), F.lower(F.array_join(items, " "))))
    return F.concat_ws(
        " ",
        F.concat(F.lit("filename:"), F.lower(file_name)),
        F.concat(F.lit("apiname:"), F.lower(api_name)),
        F.concat(F.lit("rank:"), rank.cast("string")),
        F.when(F.size(tokens) > 0, F.array_join(tokens, " ")),
        some("changelog:", notes),
        some("procedures:", names),
    )


def embedding_text(summary: Column, api_name: Column, file_name: Column, rank: Column, calls: Column, names: Column, corpus_size: int = 9750) -> Column:
    """The text that is embedded for a file."""
    domain = F.replace(F.replace(api_name, F.lit("_API"), F.lit("")), F.lit("_"), F.lit(" "))
    top = F.when(F.size(calls) > 0, F.array_join(F.slice(calls, 1, 5), ", ")).otherwise("none")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Business Function: "), summary),
        F.concat(F.lit("Component: "), api_name, F.lit(" in "), file_name),
        F.concat(F.lit("Domain: "), domain),
        F.concat(F.lit("System Importance: Rank "), rank.cast("string"), F.lit(f" of {corpus_size}")),
        F.concat(F.lit("Dependencies: "), F.size(calls).cast("string"), F.lit(" API calls including "), top),
        F.concat(F.lit("Implementation: "), F.size(names).cast("string"), F.lit(" key procedures/functions")),
    )


def summary_prompt(content: Column, file_name: Column, api_name: Column, rank: Column, calls: Column, notes: Column, names: Column) -> Column:
    """What a summariser is asked about a file."""
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(items, "\n")))
    return F.concat_ws(
        "\n",
        F.lit("Summarise this source file for semantic search."),
        F.concat(F.lit("File: "), file_name),
        F.concat(F.lit("API: "), api_name),
        F.concat(F.lit("Importance rank: "), rank.cast("string")),
        F.concat(F.lit("External calls: "), F.size(calls).cast("string")),
        section("Change notes", notes),
        section("Declared procedures and functions", names),
        F.concat(F.lit("\nSignals:\n"), content),
        F.lit("\nState its business purpose, main operations, error cases, the data it manages and the files it works with."),
    )
