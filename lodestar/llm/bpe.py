"""Byte-level BPE encoding and decoding over a distinct-word table.

Words are what the tokenizer's own pattern cuts a text into; merges never cross them, so encoding every distinct word
once and putting the ids back by position equals encoding the text.

1. Documents are dealt to chunks of bounded bytes. A chunk splits its texts and sends its distinct words to shards by the
   words' hash (exchange.py), so that all chunks' copies of a word meet in one shard.
2. A shard encodes each distinct word once and answers every chunk with the ids of its words, in the order they were sent.
3. The chunk splits its texts again and puts the ids in the words' places.
4. Decoding looks each id up in the id-to-piece table (as large as the vocabulary) and concatenates the pieces.

Nothing but the tokenizer is broadcast; a word that stands in a third of all texts is one entry per chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import U64, blocks, raw_parts, word_hashes
from .exchange import asked, chunked, merged, messages, pack_arrays, unpack_arrays

#: The pattern of the byte-level family, as its tokenizer files have it built in (white space by the Unicode property).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
BLOCK_BYTES = 1 << 20
#: Words that the tokenizer encodes at a time; its results are much larger than their ids.
TOGETHER = 8192
#: Of the messages' compression.
LEVEL = 9


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """One process's tokenizer, made from the JSON of a tokenizer file."""

    _made: dict[str, Codec] = {}

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = {t["content"]: t["id"] for t in json.loads(spec)["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = byte_letters()
        pieces = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        special_ids = set(self.special.values())
        self.pieces = [b""] * (pieces[-1][1] + 1)
        for piece, i in pieces:
            self.pieces[i] = piece.encode() if i in special_ids else bytes(letters[c] for c in piece)

    @classmethod
    def of(cls, spec: str) -> Codec:
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(spec)
        return cls._made[key]

    def split(self, text: str) -> list[str]:
        if self.special_pattern is None or not self.special_pattern.search(text):
            return WORDS.findall(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += WORDS.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + WORDS.findall(text[at:])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all, one after the other."""
        counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = [e.ids for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
            for i, w in enumerate(some) if self.special else ():
                if w in self.special:
                    ids[i] = [self.special[w]]
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), "<u4", int(counts[-1].sum())))
        return np.concatenate(counts), np.concatenate(flat)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Steps:
    def __init__(self, spec: Broadcast, shards: int) -> None:
        self.spec, self.shards = spec, shards

    def _shards(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Words as bytes, and their shards by hash."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        h = word_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
        return raw, (h >> U64(20)).astype(np.int64) % self.shards

    def ask(self, chunk: int, table: pa.Table, _: pa.Table | None) -> pa.Table:
        """The chunk's distinct words. They are sorted: that does not depend on the rows' order, and packs well."""
        split, seen = Codec.of(self.spec.value).split, set()
        for raw in table["raw"]:
            seen.update(split(raw.as_py().decode("utf-8", "replace")))
        words, shard = self._shards(sorted(seen))
        return messages(chunk, 1, shard, self.shards, lambda i: _pack_words([words[k] for k in i.tolist()]))

    def encoded(self, payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per payload the number of ids of each word, and the ids; a word that several payloads hold is encoded once."""
        number = defaultdict(count(0).__next__)
        lists = [np.fromiter(map(number.__getitem__, _unpack_words(p)), np.int64) for p in payloads]
        n, ids = Codec.of(self.spec.value).encode_words([w.decode() for w in number])
        first = np.cumsum(n) - n
        return [(n[at], _gathered(ids, first[at], n[at])) for at in lists]

    def result(self, table: pa.Table, answers: pa.Table, emit) -> pa.Table:
        """Every text is split once more: into the numbers of its words, in whose places the answers' ids are put."""
        codec, number = Codec.of(self.spec.value), defaultdict(count(0).__next__)
        of = []  # per text the numbers of its words, by first occurrence
        for raw in table["raw"]:
            words = codec.split(raw.as_py().decode("utf-8", "replace"))
            of.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        words = sorted(number)
        _, shard = self._shards(words)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        first, n_ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)  # by place in the sorted words
        flat, base = [np.zeros(0, "<u4")], 0
        for s, payload in zip(answers["shard"].to_pylist(), answers["payload"].to_pylist(), strict=True):
            counts, ids = unpack_arrays(payload, wide=False)
            at = order[cut[s] : cut[s + 1]]
            n_ids[at] = counts
            first[at] = base + np.cumsum(counts, dtype=np.int64) - counts
            flat.append(ids.astype("<u4"))
            base += len(ids)
        ids = np.concatenate(flat)
        place = np.empty(len(words), np.int64)  # a word's number to its place
        place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        out, row = [], 0
        for batch in table.combine_chunks().to_batches():
            for i, j in blocks(raw_parts(batch["raw"])[1], BLOCK_BYTES):
                own = of[row : row + j - i]
                row += j - i
                at = place[np.concatenate([np.zeros(0, np.int32), *own])]
                some = _gathered(ids, first[at], n_ids[at])
                edge = np.append(0, np.cumsum(n_ids[at]))[np.cumsum([0, *map(len, own)])].tolist()
                out.append(emit(codec, batch.slice(i, j - i), [some[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]))
        if not out:  # answers without rows do not occur, but the schema is due
            none = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)
            out.append(emit(codec, none, []))
        return pa.Table.from_batches(out)


def _gathered(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of n values from each first on, one after the other."""
    ends = np.cumsum(n)
    return values[np.arange(int(n.sum())) + np.repeat(first - ends + n, n)]


def _pack_words(words: list[bytes]) -> bytes:
    return pack_arrays(np.array([len(w) for w in words], np.int64), np.frombuffer(b"".join(words), np.uint8), level=LEVEL)


def _unpack_words(payload: bytes) -> list[bytes]:
    lengths, body = unpack_arrays(payload, wide=False)
    raw, ends = body.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _pack_ids(answer: tuple[np.ndarray, np.ndarray]) -> bytes:
    return pack_arrays(*answer, level=LEVEL)


def _digests(codec: Codec, part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
    decoded = [hashlib.sha256(codec.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in ids]
    return pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _id_lists(codec: Codec, part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
    return pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])


def _by_position(docs: DataFrame, tokenizer_path: str, emit, schema: str, chunk_bytes: int) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    rows, n = chunked(docs, chunk_bytes)
    shards = max(1, -(-n // 8))  # few, so that a message's sorted words are near each other and pack well
    steps = Steps(spec, shards)
    answers = merged(asked(rows, steps.ask), steps.encoded, shards, _pack_ids)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: steps.result(t, a, emit), schema)


def encode(docs: DataFrame, tokenizer_path: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text; a null text is empty and has no ids. Very long texts are a
    chunk of their own."""
    return _by_position(docs, tokenizer_path, _id_lists, "doc_id long, ids array<int>", chunk_bytes)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), through the id-to-piece table; bytes that are no UTF-8 become U+FFFD. A null
    list gives a null text."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(file.read())

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(spec.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(f, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: what encode() and decode() give, without storing
    the ids between. Special tokens' strings in a text become their ids, as the tokenizer does by default. Rows keep
    their number and ids (null ones too); an empty table gives an empty result; other columns are not looked at."""
    return _by_position(docs, tokenizer_path, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", chunk_bytes)


def default_tokenizer(spark: SparkSession) -> str:
    """The tokenizer file: spark.conf lodestar.bpe.tokenizer, or the public one that is installed."""
    import public_tokenizers

    return spark.conf.get("lodestar.bpe.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")
