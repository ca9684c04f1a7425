"""Rules of text quality, with repetition measured by suffix arrays.

Words are the symbols. For a block of documents one string of word numbers is made in which every document has numbers of
its own and a word that its document holds once stands for a boundary, so that no repeat crosses a document. Its suffix
array and permuted common prefixes give, for every place, the longest run of words that also starts elsewhere in the
document. Intervals of the common prefixes that reach `least_words` are the repeated substrings; those places whose run
is not the rest of the run before are the starts of the maximal ones. Their spans are united, and a document is kept while
the union covers a limited part of its characters and the longest repeat is limited too.

One pass over the documents without a shuffle; a row's result depends on that row alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BASES, U64, blocks, mix, narrow, raw_parts, word_hashes, word_spans
from .suffix import symbol_suffix_array, whole_common_prefixes

BLOCK_BYTES = 1 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words of the base rule's windows.
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """The base rules, and how far repeats may go: repeated substrings count from least_words on, may cover so many
    percent of the characters of the words, and one of them may have so many words."""

    min_words: int = 20
    repeat_percent: int = 30
    least_words: int = 4
    covered_percent: int = 40
    longest_words: int = 400


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the stretches between consecutive edges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For every place of a string of numbers the length of the longest substring that starts there and somewhere else
    too. Symbols that occur once end every repeat; a run of them is one boundary."""
    n = len(symbols)
    length = np.zeros(n, np.int64)
    _, inverse, count = np.unique(symbols, return_inverse=True, return_counts=True)
    often = count[inverse] > 1
    keep = often.copy()
    keep[1:] |= often[:-1]  # the first of each run of single symbols
    at = np.flatnonzero(keep)
    if not often.any():
        return length
    reduced = np.append(np.unique(inverse[at], return_inverse=True)[1] + 1, 0)
    order = symbol_suffix_array(reduced)
    before = whole_common_prefixes(reduced, order)  # with the predecessor, by place
    after = np.zeros(len(reduced), np.int64)
    after[order[:-1]] = before[order[1:]]
    length[at] = np.maximum(before, after)[:-1]
    return length


def maximal_starts(length: np.ndarray, least: int) -> np.ndarray:
    """Where a repeat of `least` symbols or more begins that is not the rest of the one that begins before it."""
    return (length >= least) & (np.append(0, length[:-1]) <= length)


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a repeat of `least` symbols or more: the union of the spans of the maximal ones."""
    starts = np.flatnonzero(maximal_starts(length, least))
    mark = np.zeros(len(length) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.subtract.at(mark, starts + length[starts], 1)
    return np.cumsum(mark[:-1]) > 0


def _duplicate_lines(body: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document, its lines with a word that equal an earlier one. Lines are compared by two 64-bit hashes."""
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets[:-1]] = True
    edge[np.flatnonzero(body == 10) + 1] = True
    edge[len(body)] = False
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(body))
    ends_line = np.zeros(len(first), bool)
    ends_line[last > first] = body[last[last > first] - 1] == 10
    has_word = np.diff(np.searchsorted(starts, np.append(first, len(body)))) > 0
    first, last = first[has_word], (last - ends_line)[has_word]
    doc = np.searchsorted(offsets, first, "right") - 1
    h = [word_hashes(body, first, last, lane) for lane in (0, 1)]
    order = np.lexsort((h[1], h[0], doc))
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (doc, *h)])
    return np.bincount(doc[order[same]], minlength=len(offsets) - 1)


def measured(body: np.ndarray, offsets: np.ndarray, least_words: int) -> dict[str, np.ndarray]:
    """The figures of some documents, whose bytes lie between the offsets."""
    n = len(offsets) - 1
    starts, ends, doc = word_spans(body, offsets)
    edges = np.searchsorted(doc, np.arange(n + 1))
    points = np.zeros(len(body) + 1, np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    length = longest_repeats(mix(word_hashes(body, starts, ends) + doc.astype(U64) * U64(BASES[3])))
    new = maximal_starts(length, least_words)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    return {
        "n_words": np.diff(edges),
        "word_chars": _sums(chars, edges),
        "n_symbols": _sums(SYMBOLS[body], offsets),
        "n_dup_lines": _duplicate_lines(body, offsets, starts),
        "n_repeat_words": _sums(covered(length, WINDOW), edges),
        "n_repeats": _sums(new, edges),
        "repeated_chars": _sums(np.where(covered(length, least_words), chars, 0), edges),
        "longest_repeat": longest,
    }


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "repeated_chars", "longest_repeat"]


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_repeats (places where a
    maximal repeat begins), repeated_chars (code points of the words they cover) and longest_repeat (words), a row per
    row of docs.

    A null or empty text has no words, fails the base and is not kept; a null doc_id stays null; repeated rows get
    equal results; a very long text is measured whole. Words and lines are compared by hashes of their bytes (64 bits
    within a document's words in a run, 128 for a line). Other columns are not looked at; an empty table gives an empty
    result."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = raw_parts(batch["raw"])
            for i, j in blocks(offsets, BLOCK_BYTES):
                m = measured(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], limits.least_words)
                failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.repeat_percent * m["n_words"])
                kept = ~failed & (100 * m["repeated_chars"] <= limits.covered_percent * m["word_chars"]) & (m["longest_repeat"] <= limits.longest_words)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), *[pa.array(m[c].astype(np.int64)) for c in COLUMNS], pa.array(failed), pa.array(kept)], ["doc_id", *COLUMNS, "base_failed", "kept"])

    return narrow(docs).mapInArrow(f, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean")
