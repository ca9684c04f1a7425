import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestar.llm.bpe import Codec, decode, encode, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, raw int"


def texts(seed):
    r = random.Random(seed)
    alphabet = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "​", "'s", "'LL", "don't", "word", "Wörter", "été", "123", "½", "٣", "你好", "🙂", "👍🏽", "é", "!?", "--", "_", "<|endoftext|>", "<|endoftext", "\x00", "﻿", "ﬁ", "ǅ"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)]


def expected(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_the_tokenizer(spark):
    rows = list(enumerate(texts(1))) + [(None, "a b"), (7, None), (7, None), (8, ""), (9, "lang " * 50_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert sorted((tuple(x) for x in round_trip(df, PATH, chunk_bytes=3000).collect()), key=repr) == expected(rows)


def test_encode_then_decode(spark):
    rows = list(enumerate(texts(2)))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert sorted(map(tuple, decode(encode(df, PATH), PATH).collect())) == rows


def test_invalid_bytes_decode_as_the_tokenizer_does():
    t, codec = Tokenizer.from_file(PATH), Codec.of(open(PATH, encoding="utf-8").read())
    r = random.Random(5)
    for _ in range(300):
        ids = [r.randrange(50257) if r.random() < 0.5 else r.randrange(256) for _ in range(12)]
        assert codec.decode(np.array(ids)) == t.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_a_word_is_encoded_once(spark):
    """Two chunks ask one shard for the same words; it encodes each of them once and answers both."""
    from lodestar.llm.bpe import Steps, _pack_words

    class Held:
        value = open(PATH, encoding="utf-8").read()

    steps, asked = Steps(Held, 1), []
    codec = Codec.of(Held.value)
    real = codec.encode_words
    codec.encode_words = lambda words: (asked.extend(words), real(words))[1]
    try:
        a, b = steps.encoded([_pack_words([b" one", b" two"]), _pack_words([b" two", b" three", b""])])
    finally:
        del codec.encode_words
    assert asked == [" one", " two", " three", ""] and a[0].tolist()[1] == b[0].tolist()[0] and b[0].tolist()[2] == 0
