from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from orrery.llm import bpe, token_store
from orrery.llm.common import shared_dir

RANKS, VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stitching_equals_reading_at_once():
    random.seed(3)
    parts = ["the ", "'ll", "'s", "\n", "  ", "a", "é", "漢", "1", "23", " ", "!?", "\t", "'re", "o" * 140, " " * 90]
    text = "".join(random.choice(parts) for _ in range(5000))
    own = bpe.encoder(RANKS, P.PATTERN)
    for step, overlap in ((100, 30), (64, 16), (1000, 100), (50, 8)):
        assert own.boundaries(text, step, overlap) == own.ends(text, 0, len(text))


def test_bpe_equals_library(spark, odd, empty):
    own = reference()
    got = sorted(map(tuple, bpe.round_trip(odd, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for r in odd.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def test_bpe_keeps_columns_and_decodes(odd):
    coded = bpe.encode(odd, RANKS, P.PATTERN)
    assert coded.columns == [c for c in odd.columns if c != "ids"] + ["ids", "n_tokens"]
    for r in bpe.decode(coded, RANKS, P.PATTERN).collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


def test_store_equals_library(spark, odd, empty):
    own = Tokenizer.from_file(VOCABULARY)
    path = shared_dir(spark)
    token_store.write(odd, path, VOCABULARY)
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    want, at = [], 0
    for r in rows:
        ids = np.array(own.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, token_store.read(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    assert token_store.read_one(spark, path, 7) == [own.encode(rows[-3]["text"], add_special_tokens=False).ids + [1]]
    other = shared_dir(spark)
    token_store.write(empty, other, VOCABULARY)
    assert token_store.read(spark, other).count() == 0


def test_words_by_stem_equal_library():
    own, words = Tokenizer.from_file(VOCABULARY), token_store.Words(VOCABULARY, "<u2")
    random.seed(5)
    bits = ["Hello", "world", "WORLD", "Éa", "éa", ".", ",", "!?", "'s", "\"", "\x01", "\n", " ", "  ", "\t", "a\u0301", "I\u0307", "Σ", "<|endoftext|>", "x" * 70, "1", "٣", "\u3000", "\x85", "ß", "İ", "K", ")", ":"]
    texts = ["".join(random.choice(bits) for _ in range(random.randrange(0, 40))) for _ in range(4000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, raw in zip(part, words.serialised(part, 1), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == own.encode(t, add_special_tokens=False).ids + [1], t


def test_special_tokens_as_the_library_takes_them():
    words = token_store.Words(VOCABULARY, "<u2")
    texts = ["a <|endoftext|> b", "plain", "", "<|startoftext|>", "a<|endoftext|>b<|ENDOFTEXT|> <|endoftext|", "plain again"]
    got = [np.frombuffer(raw, "<u2").tolist() for raw in words.serialised(texts, 1)]
    assert got[0] == [320, 49407, 321, 1] and got[3] == [49406, 1]
    assert got == [Tokenizer.from_file(VOCABULARY).encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_chunks_in_rows_equal_library(spark):
    random.seed(9)
    parts = ["the ", "'ll", "'s", "\n", "  ", "a", "é", "漢", "👍", "1", "23", " ", "!?", "\t", "'re", "o" * 140, " " * 90]
    mixed = ["".join(random.choice(parts) for _ in range(random.randrange(1, 900))) for _ in range(40)]
    # Runs that go across overlaps, and rows that share an id and a text.
    texts = [*mixed, "x" * 5000, " " * 3000 + "y", "ab " * 2000, "ab " * 2000]
    rows = [(i if i < 42 else 42, t) for i, t in enumerate(texts)] + [(None, "z " * 400), (100, None), (101, "")]
    own = reference()
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for huge, step, overlap in ((200, 100, 30), (150, 64, 16), (50, 300, 60)):
        got = sorted(map(tuple, bpe.round_trip(docs, RANKS, P.PATTERN, huge, step, overlap).collect()), key=str)
        assert got == sorted(want, key=str)


def test_other_vocabularies_are_encoded_whole(tmp_path):
    from tokenizers import models, pre_tokenizers

    # Byte-level pieces that keep case and take a blank along: words by themselves would be wrong.
    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    own = Tokenizer(models.BPE({c: i for i, c in enumerate([*alphabet, "\u0120a", "ab"])}, [("\u0120", "a"), ("a", "b")]))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.save(str(tmp_path / "other.json"))
    words = token_store.Words(str(tmp_path / "other.json"), "<u2")
    assert not words.by_word and token_store.Words(VOCABULARY, "<u2").by_word
    for text in ("ab ab Ab", "", " a"):
        assert np.frombuffer(words.serialised([text], 1)[0], "<u2").tolist() == own.encode(text, add_special_tokens=False).ids + [1]
