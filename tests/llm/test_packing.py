import itertools
import struct
import zlib
from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import packing


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary()[0])


@cache
def encoder():
    return packing.Encoder(*packing.default_vocabulary())


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = ["", "a b c", " two  spaces   here ", "it's don't we'll", "line\n\n next\t tab \n", "é 中文 😀", "<|endoftext|> mid <|endoftext|>", "x y  z", "1,234.5 (ok)! --- |"]


def test_encoder_equals_tokenizers():
    encode = encoder()
    for text in TEXTS * 2:
        assert list(struct.unpack(f"<{len(b := encode(text)) // 4}I", b)) == ids_of(text)[:-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'st .,\n\t  é1中!", max_size=60))
def test_encoder_on_any_text(text):
    encode = encoder()
    for _ in range(2):
        assert list(struct.unpack(f"<{len(b := encode(text)) // 4}I", b)) == ids_of(text)[:-1]


def test_encoder_beside_other_white_space():
    """No single space is a cut where its neighbour is white space of any kind."""
    encode = encoder()
    texts = ["end. \u00a0 \u00a0 Next", "\u00a0 \u00a0 \u00a0 Indented line", "a\u00a0 b", "a \u00a0b", "a \u2003 \u3000 b\u0085 c", "a b\n"]
    texts += ["".join(c) for n in range(1, 6) for c in itertools.product("a \n\t\u00a0", repeat=n)]
    for text in texts:
        for _ in range(2):
            assert list(struct.unpack(f"<{len(b := encode(text)) // 4}I", b)) == ids_of(text)[:-1], repr(text)


def check(rows, texts, capacity):
    bins = {}
    for i, t in texts.items():
        ids = ids_of(t)
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(mine):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and 0 < len(part) == r["length"] <= capacity
            at += r["length"]
        assert at == len(ids)
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack(spark):
    texts = {k: t for k, t in enumerate([*TEXTS, None, "word " * 5000, "é" * 3000])}
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, piece string, length int")
    rows = packing.pack(packing.pieces(docs, capacity=64), 64, shard=40).collect()
    check(rows, texts, 64)
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0
    twice = packing.pack(packing.pieces(docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1"))))
    assert twice.count() == 2


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.op2_best_fit_packing(spark, sf).collect()
    n = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, packing.CAPACITY)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // packing.CAPACITY) * 1.001 + 1




@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25))
def test_rule_is_sum_of_squares(lengths):
    sequence, offset = packing.sum_of_squares(np.array(lengths, np.int64), 12)
    gaps, got = {}, []
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths, strict=True):
        assert gaps.get(s, 12) == 12 - o
        before = dict(gaps)
        gaps[s] = 12 - o - n
        values = [g for g in gaps.values() if g]
        got = sum(values.count(g) ** 2 for g in set(values))
        # No other open place for this item gives a smaller sum, and a new one is opened only without any.
        open_ = {k: g for k, g in before.items() if g >= n}
        assert (s in before) == bool(open_)
        for other, room in open_.items():
            trial = [g for k, g in before.items() if k != other and g] + ([room - n] if room > n else [])
            assert got <= sum(trial.count(g) ** 2 for g in set(trial))
