"""Scalar text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the source language that corpus stop-words never include.
LANGUAGE_KEYWORDS = (
    "select from where insert update delete create alter drop table index view procedure function package trigger declare begin end "
    "if then else elsif loop while for cursor exception when raise return commit rollback varchar2 number date boolean integer char "
    "clob blob timestamp null not and or in exists between like is as on join left right inner outer union order group having distinct all"
).split()
#: Words common in programs and their comments that carry no meaning for search.
PROGRAMMING_STOPWORDS = (
    "the and or not in on at to for of with by from into this that these those is are was were be been being have has had do does did "
    "will would could should may might must can shall todo fixme hack note bug issue temp temporary client server info data value record "
    "field column set get new old var val tmp ref id key name type size len max min def default null true false yes no ok err error warn "
    "warning also then else when where what who why how some any all each every many few more most other another same different such like than"
).split()
#: Common English words.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her "
    "hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't "
    "won won't wouldn wouldn't"
).split()
#: Marks, comment markers, rules, white space, letters, digits and short noise tokens.
NOISE_TOKENS = [
    *"_ > < - / ; = \" { } [ ] . , ( ) : $ ' ? @ & ! | ^ ~ # % \\ -- --- ==== /* */ // /** <!-- --> <? ?>".split(),
    "---------------------------------------------------------------------------------------------------",
    "================================================================================",
    "********************************************************************************",
    *["\n", "\t", "\r", " "],
    *"a i o x y z t s n m l k j h g f e d c b".split(),
    *"as an is it at on or if we he me my no so up us to of eq lu".split(),
    *"0 1 2 3 4 5 6 7 8 9 00 01 10 11 20 30 50 100".split(),
    *"xml utf xsi www w3 org v p r c w tmp val ref id cd".split(),
]


def stopwords(english: list[str] | None = None, corpus: list[str] | None = None) -> set[str]:
    """English stop-words (those above unless given) with the programming ones and the noise tokens, and with the words
    that a corpus adds (lexical.corpus_stopwords)."""
    return {*(ENGLISH_STOPWORDS if english is None else english), *PROGRAMMING_STOPWORDS, *NOISE_TOKENS, *(corpus or [])}


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it (a lambda variable is not inlined)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(content: Column, first: int | None = None) -> Column:
    parts = F.split(content, "\n")
    return F.slice(parts, 1, first) if first else parts


def words(c: Column) -> Column:
    """Split at runs of white space, without empty strings."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def first_seen(items: Column, key=F.lower) -> Column:
    """The items whose key has not come before, in order."""
    return let(items, lambda a: let(F.transform(a, key), lambda keys: F.filter(a, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)))


def evenly_spaced(items: Column, count: Column | int) -> Column:
    """At most `count` items: the first, the last and evenly spaced ones between (position 1 + step * i, cut to an int)."""
    return let(items, lambda a: _evenly_spaced(a, F.lit(count) if isinstance(count, int) else count))


def _evenly_spaced(items: Column, count: Column) -> Column:
    n = F.size(items)
    middle = F.greatest(F.least(count - 2, n - 2), F.lit(0))
    step = (n - 2) / (middle + 1)
    at = F.filter(F.when(middle > 0, F.transform(F.sequence(F.lit(1), F.greatest(middle, F.lit(1))), lambda i: (1 + step * i).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: i < n - 1)
    picked = F.concat(F.slice(items, 1, 1), F.transform(at, lambda i: F.element_at(items, i + 1)), F.when((count > 1) & (n > 1), F.slice(items, n, F.lit(1))).otherwise(F.slice(items, 1, 0)))
    return F.when((n == 0) | (count <= 0), F.slice(items, 1, 0)).when(count >= n, items).when(n < 3, F.slice(items, F.lit(1), F.greatest(count, F.lit(0)))).otherwise(F.slice(picked, F.lit(1), F.greatest(count, F.lit(0))))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def content_hash(c: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def clean_punctuation(c: Column) -> Column:
    """Marks to spaces, but for dots inside names and underscores (hyphens go with the arithmetic signs)."""
    for pattern in (r"[(){}\[\];,]", r"[=<>!]+", r"[+\-*/%&|^~]", r"['\"`]", r"[:@#$]", r"\.(?=\s|$)", r"(?<=\s)\.", r"(?U)[^\w\s._-]"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def clean_source(content: Column) -> Column:
    """Code and comment text in one line: blank lines and bare markers out, comments unwrapped, white space collapsed."""

    def keep(line: Column) -> Column:
        comment = strip(F.substring(line, 3, 2**31 - 1))
        inner = strip(F.substring(line, F.lit(3), F.length(line) - 4))
        code = F.regexp_replace(line, r"(?U)\s+", " ")
        return (
            F.when((line == "") | line.isin("--", "/*", "*/"), None)
            .when(line.startswith("--"), F.when((F.length(comment) > 3) & ~comment.startswith("===="), comment))
            .when(line.startswith("/*") & line.endswith("*/"), F.when(F.length(inner) > 3, inner))
            .otherwise(F.when(F.length(code) > 2, code))
        )

    kept = F.filter(F.transform(lines(content), lambda x: keep(strip(x))), lambda x: x.isNotNull())
    return strip(F.regexp_replace(clean_punctuation(F.array_join(kept, " ")), r"(?U)\s+", " "))


def basic_tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores, as they are."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def identifier_tokens(tokens: Column, drop: set[str]) -> Column:
    """Lower-cased tokens of two characters or more that are identifiers and no stop-words."""
    low = F.transform(tokens, lambda t: F.lower(strip(t)))
    return F.filter(low, lambda t: (F.length(t) > 1) & t.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$") & ~t.isin(*sorted(drop)))


def best_line(content: Column, query_words: Column, max_chars: int = 200) -> Column:
    """The line that holds most of the query's words (lower-cased substrings); the first among equals."""
    scored = F.transform(lines(content), lambda x, i: F.struct(F.size(F.filter(query_words, lambda w: F.lower(x).contains(w))).alias("score"), (-i).alias("place"), strip(x).alias("line")))
    fit = F.filter(scored, lambda s: (s["score"] > 0) & (F.length(s["line"]) > 10))
    cut = lambda line: F.when(F.length(line) > max_chars, F.concat(F.substring(line, 1, max_chars), F.lit("..."))).otherwise(line)
    return F.coalesce(let(F.array_max(fit)["line"], cut), F.lit("No preview available"))


def query_words(query: Column) -> Column:
    return words(F.lower(query))


def resolve_path(path: Column) -> Column:
    """Forward slashes; a leading _work/ becomes source/."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^_work/", "source/")


def safe_version(version: Column) -> Column:
    return F.regexp_replace(version, r"(?U)[^\p{Alnum}._-]", "")
