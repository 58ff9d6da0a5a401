"""Word BPE against the tokenizers library."""

import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import wordbpe

from .fixtures import SF, edge_docs, empty_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(texts):
    codec = wordbpe.codec(PATH)
    got = [[np.zeros(0, "<u4")] for _ in texts]
    for row, ids in codec.encoded((i, t.encode()) for i, t in enumerate(texts)):
        got[row].append(ids)
    for text, ids, want in zip(texts, map(np.concatenate, got), library().encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, text[:80]
        assert codec.decode(ids).decode() == library().decode(want.ids, skip_special_tokens=False)


def test_every_kind_of_character():
    points = [*range(0x3100), *range(0xA000, 0xD7FF, 11), *range(0xE000, 0x1FFFF, 13)]
    check([f.replace("%", chr(c)) for c in points for f in ("a%b", "%", "1% e%x")])


def test_mixed_texts():
    rng = random.Random(5)
    letters = "abcABC '’\t\n\r\x0b\x0c\x1c\x85  <|>stv.,!09é́Σσςİ漢字\xa0　ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    check(texts + [t + "<|endoftext|>" + t + "<|startoftext|><|endoftext|<|ENDOFTEXT|>" for t in texts[:500]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(texts):
    check(texts)


def test_words_of_every_length():
    """One by one and side by side, around the sizes of the forests."""
    rng = random.Random(3)
    check(["".join(rng.choice("aeinsth") for _ in range(n)) for n in [*range(1, 140)] * 6])
    check(["a" * n for n in range(1, 140)])


@pytest.mark.parametrize("letters,n", [("x", 100_000), ("abcdefghij", 100_000), ("abc1.'|<>é", 200_000), ("ab c\n", 2_500_000), ("漢字", 20_000)])
def test_long_texts(letters, n):
    rng = random.Random(n)
    check(["".join(rng.choice(letters) for _ in range(n))])


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE", 5)
    monkeypatch.setattr(wordbpe, "SLICE", 40)
    check(["some words and some more words", "other words, some of them met", "é è ê some é"] * 5)


def test_rows(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "'x' as word", "1 as shard")
    docs = edge_docs(spark).select("doc_id", "text", "word", "shard").unionByName(some)
    docs = docs.unionByName(docs.where("doc_id = 1007"))  # a repeated row
    rows = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in wordbpe.encode_decode(docs).collect())
    want = []
    for r in docs.collect():
        ids = library().encode(r.text or "", add_special_tokens=False).ids
        text = library().decode(ids, skip_special_tokens=False)
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows == sorted(want)
    assert wordbpe.encode_decode(empty_docs(spark)).count() == 0
    full = {r.doc_id: r for r in wordbpe.encode_decode(edge_docs(spark), full=True).collect()}
    assert full[5].ids == library().encode("Two Words").ids and full[5].decoded == "two</w> words</w>" and full[1].ids == []
