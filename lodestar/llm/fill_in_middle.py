"""Fill-in-the-middle transformation of documents.

A Split pre-tokenizer of the tokenizers library with isolated matches cuts a text into runs of Latin letters and single
other characters, nothing trained, and gives their offsets in code points. The number of offsets is n; the cuts are
ranks among them, and the text's slices at the ranked offsets are prefix, middle and suffix. What the cuts and the form
are drawn from is a hash of the doc_id, so a document is transformed alike wherever and however often it is read.

One pass over the documents without a shuffle: a row's result depends on that row alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, narrow, raw_parts

UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 1 << 20
#: Code points that are cut into units at a time; every unit's offsets are Python objects for a moment.
PIECE = 1 << 16


@cache
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(UNITS), behavior="isolated")


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z"


def unit_ends(text: str, piece: int = PIECE) -> np.ndarray:
    """The end of each unit, in code points. A long text is cut in pieces behind characters that are no letters, where a
    unit ends anyway, so that the units of one piece at a time are held as objects."""
    out, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        to = min(at + piece, len(text))
        while to < len(text) and _letter(text[to - 1]):
            to += 1
        found = _splitter().pre_tokenize_str(text[at:to])
        out.append(np.fromiter((end for _, (_, end) in found), np.int64, len(found)) + at)
        at = to
    return np.concatenate(out)


def drawn(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit integers of a document: the first 8-digit groups of the hex SHA-256 of `seed:doc_id`, where a
    null id is written as nothing."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, draw: list[int], plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or draw[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    low, high = sorted(h % (n + 1) for h in draw[:2])
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draw[3] % 100 < spm_percent:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units of the whole text), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if
    plain) and output, a row per row of docs.

    A null text is the empty one, which is plain, as is a text that holds one of the marks. A null doc_id draws as the
    empty id; repeated rows, and texts that share an id, draw alike. Very long texts are cut into units piece by piece.
    Other columns, whatever their names, are not looked at; an empty table gives an empty result."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = raw_parts(batch["raw"])
            for i, j in blocks(offsets, BLOCK_BYTES):
                part = batch.slice(i, j - i)
                rows = [transformed(raw.as_py().decode("utf-8", "replace"), drawn(d, seed), plain_percent, spm_percent) for d, raw in zip(part["doc_id"].to_pylist(), part["raw"], strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return narrow(docs).mapInArrow(f, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a form's output was made from. No mark can begin inside another or at a text's end, so the output
    of a text without marks has exactly the three that were put there."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
