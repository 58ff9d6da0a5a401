"""Suffix dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gneiss.llm import suffixes

from .fixtures import SF, edge_docs, empty_docs


def brute(texts, depth):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + depth] for r in raws for i in range(len(r) - depth + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def planted(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gam", "d", "ε", "zeta", "eta!"]
    say = lambda n: " ".join(rng.choices(words, k=n)) + str(rng.random())
    shared = [say(n) for n in (20, 40, 60, 120)]
    texts = []
    for i in range(60):
        t = say(rng.randrange(1, 60))
        for p in rng.sample(shared, rng.randrange(0, 3)):
            cut = rng.randrange(0, 12)
            t += p[cut : len(p) - rng.randrange(0, 12)] + say(rng.randrange(0, 30))
        texts.append(t)
    line = say(12)
    texts += [line + say(9) for _ in range(40)]
    return texts + [texts[0], texts[3], texts[3], "ab" * 500, "abc" * 90, "x" * 200, "x" * 199]


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    return [tuple(r)[1:] for r in sorted(suffixes.removals(df, **options).collect())]


@pytest.mark.parametrize("depth,gram", [(200, 50), (40, 10)])
def test_against_brute_force(spark, depth, gram):
    texts = planted() + [t for t in (r.text for r in edge_docs(spark).collect())]
    want = brute(texts, depth)
    assert run(spark, texts, depth=depth, gram=gram) == want
    assert sum(w[1] for w in want) > 1000


@pytest.mark.parametrize("buffer,slice_", [(3000, 1 << 19), (1, 700), (300, 90)])
def test_large_groups_take_further_digits(spark, monkeypatch, buffer, slice_):
    """Groups that outgrow a task's buffer, down to cores of whole windows, and texts cut into slices."""
    monkeypatch.setattr(suffixes, "BUFFER", buffer)
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    texts = planted(4)
    assert run(spark, texts, depth=60, gram=20) == brute(texts, 60)


@pytest.mark.parametrize("depth", [3, 8, 13, 200])
def test_digit_passes(depth):
    rng = np.random.default_rng(depth)
    buf = rng.choice(np.frombuffer(b"ab", np.uint8), 4000)
    buf[1000:1400] = buf[2000:2400]
    at, group = rng.integers(0, len(buf) - depth, 900), rng.integers(0, 3, 900)
    seen = Counter((g, buf[x : x + depth].tobytes()) for x, g in zip(at, group))
    want = [seen[g, buf[x : x + depth].tobytes()] > 1 for x, g in zip(at, group)]
    assert suffixes._equal_windows(buf, at, group, depth).tolist() == want


def test_rows_that_repeat_an_id(spark):
    text = "a passage that is told twice, " * 8
    df = spark.createDataFrame([(1, text), (1, text), (1, "short"), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(suffixes.removals(df).collect(), key=str)
    assert [(r.doc_id, r.n_bytes, r.n_removed) for r in got] == [(1, 240, 240), (1, 240, 240), (1, 5, 0), (None, 0, 0), (None, 240, 240)]


def test_generated_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removals(docs).collect()}
    assert [got[r.doc_id] for r in docs.collect()] == brute(texts, 200)


def test_cleaned(spark):
    p = "é passage that is told again and again, " * 7
    p = p[:280]
    rows = [(1, f"one {p} end", 9), (2, f"two {p} fin", 8), (None, None, 7), (4, "", 6), (5, "short", 5), (6, "z" * 300, 4), (7, "z" * 300, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = {r.doc_id: r for r in suffixes.cleaned(df).collect()}
    assert set(got) == {1, 2, None, 4, 5} and got[None].text is None and got[5].text == "short"
    # the space before and after the passage repeat as well
    assert (got[1].text, got[2].text, got[1].runs) == ("oneend", "twofin", 9)


def test_empty(spark):
    assert suffixes.removals(empty_docs(spark)).count() == 0 and suffixes.cleaned(empty_docs(spark)).count() == 0
