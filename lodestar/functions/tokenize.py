"""Tokenizers and stemming that no built-in expresses: Arrow-batched functions, for use where an index is built.

The stemmer follows the published English (Porter2) algorithm of the Snowball project."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import identifier_tokens

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
#: Words with stems of their own, and words that stop after step 1a.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STOPS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Suffix replacements of steps 2 and 3, longest first.
STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    w = w.replace("’", "'").removeprefix("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+s$", w):
        w = w[:-1]
    if w in STOPS:
        return w.lower()
    # 1b
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short(w) and len(w) <= r1:
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    for suffix, new in STEP2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ogi" or w[at - 1 : at] == "l") and (suffix != "li" or w[at - 1 : at] in LI_ENDINGS):
                w = w[:at] + new
            break
    # 3
    for suffix, new in STEP3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= (r2 if suffix == "ative" else r1):
                w = w[:at] + new
            break
    # 4
    for suffix in STEP4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmed(tokens: Column) -> Column:
    def f(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ts: None if ts is None else [stem(t) for t in ts])

    f.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(f, T.ArrayType(T.StringType()))(tokens)


def subword_tokens(content: Column, ranks_path: str, pattern: str, drop: set[str]) -> Column:
    """Tokens of a byte-pair vocabulary (a rank file, read on the driver), cleaned like identifier_tokens()."""
    with open(ranks_path, "rb") as file:
        ranks = file.read()

    def f(batch: pd.Series) -> pd.Series:
        encoding = _encoding(ranks, pattern)
        return batch.map(lambda t: None if t is None else [encoding.decode([i]) for i in encoding.encode_ordinary(t)])

    f.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return identifier_tokens(F.pandas_udf(f, T.ArrayType(T.StringType()))(content), drop)


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
