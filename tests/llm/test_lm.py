"""Language-model scoring against brute force, and the trie against a dictionary."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gneiss.llm import lm
from gneiss.llm.trie import VALUES, EliasFano, Trie, quantise

from .fixtures import SF, edge_docs, empty_docs


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1 << 64), (1000, 1 << 64), (1000, 1200), (5000, 1 << 40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64, endpoint=False))
    ef = EliasFano(v, universe)
    q = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64)])
    at, same = ef.next_geq(q)
    assert (at == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()
    assert (ef.get(np.arange(len(v))) == v).all()
    if n == 1000:
        assert ef.nbytes() < 8 * n + 4 * n + 200


def test_elias_fano_of_long_runs():
    """Hundreds of values in one bucket, and empty buckets between."""
    v = np.unique(np.concatenate([np.arange(1000, 1700), np.arange(5_000_000, 5_000_130), [0, 1, 2**40, 2**50]]).astype(np.uint64))
    ef = EliasFano(v, 1 << 51)
    q = np.unique(np.concatenate([v, v + np.uint64(1), np.random.default_rng(0).integers(0, 1 << 51, 3000, dtype=np.uint64), [4_999_999, 999, 2**51 - 1]]).astype(np.uint64))
    at, same = ef.next_geq(q)
    assert (at == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all() and (ef.get(np.arange(len(v))) == v).all()


def test_trie():
    rng = np.random.default_rng(2)
    c, s = rng.integers(0, 1 << 63, 200, dtype=np.uint64)[rng.integers(0, 200, 5000)], rng.integers(0, 50, 5000).astype(np.uint64)
    n = rng.integers(0, 4, 5000)
    parent, w = rng.integers(0, 5000, 8000), rng.integers(0, 40, 8000).astype(np.uint64)
    n3 = np.where(n[parent] > 0, rng.integers(0, 3, 8000), 0)
    hot = np.where(c == c[0], 777, 0)
    two, whole, three = Counter(), Counter(), Counter()
    for a, b, k in zip(c.tolist(), s.tolist(), n.tolist()):
        two[a, b] += k
        whole[a] += k
    whole[int(c[0])] = 777
    for p, x, k in zip(parent.tolist(), w.tolist(), n3.tolist()):
        three[int(c[p]), int(s[p]), x] += k
    t = Trie(c, s, n, hot, parent, w, n3, 5.0)
    code = lambda p: quantise(np.array([p]))[0]
    pairs = [(a, b) for a in [*whole, 12345] for b in range(60)]
    at = t.bigrams(np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64))
    for (a, b), x, y in zip(pairs, t.codes_of(at).tolist(), t.weights_of(at).tolist()):
        assert x == (code(two[a, b] / (whole[a] + 5.0)) if two[a, b] else 0) and y == (code(5.0 / (two[a, b] + 5.0)) if two[a, b] else 255)
    i, x = np.repeat(np.arange(len(pairs)), 45), np.tile(np.arange(45), len(pairs)).astype(np.uint64)
    for k, last, got in zip(i.tolist(), x.tolist(), t.trigrams(at[i], x).tolist()):
        n_ = three[(*pairs[k], last)]
        assert got == (code(n_ / (two[pairs[k]] + 5.0)) if n_ else 0)
    assert VALUES[255] == 1 and abs(math.log10(VALUES[code(0.01)]) + 2) < 0.02


def brute(rows, mu, order=3):
    docs = []
    for d, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        docs.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0D]+", low), None]))
    c, two, three, begins = Counter(), Counter(), Counter(), 0
    for d, held, ws in docs:
        if not held:
            c.update(ws)
            two.update(zip([0, *ws[:-1]], ws))
            three.update(zip([0, *ws[:-2]], ws[:-1], ws[1:]))
            begins += 1
    n, v = sum(c.values()), len(c)
    near = lambda p: float(VALUES[quantise(np.array([p]))[0]]) if p else 0.0
    out = {}
    for d, held, ws in docs:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        model = 0.0
        for i, w in enumerate(ws):
            t = ws[i - 1] if i else 0
            ct = c[t] if i else begins
            p = near(two[t, w] / (ct + mu)) + mu / (ct + mu) * (c[w] + 1) / (n + v + 1)
            if i and order > 2:
                s = ws[i - 2] if i > 1 else 0
                p = near(three[s, t, w] / (two[s, t] + mu)) + near(mu / (two[s, t] + mu)) * p
            model += math.log10(p)
        out.setdefault(d, []).append((held, len(ws), sum(c[w] > 0 for w in ws), n, base, model))
    return out


@pytest.mark.parametrize("small,order", [(False, 3), (True, 3), (True, 2)])
def test_against_brute_force(spark, monkeypatch, small, order):
    if small:
        monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
        monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
        monkeypatch.setattr(lm, "FIND", 100)
    docs = edge_docs(spark).select("doc_id", "text", "word").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "'x' as word"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, seen = brute(rows, lm.MU, order), 0
    got = lm.score(docs, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base, model = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(model, rel=1e-6)
        seen += held
    assert seen > 10
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty(spark):
    assert lm.score(empty_docs(spark)).count() == 0


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b a b"), (1, "a b a b"), (1, None), (None, "b a"), (None, "")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [x for xs in brute(rows, lm.MU).values() for x in xs]
    assert sorted((r.n_tokens, round(r.base_score, 9), round(r.score, 6)) for r in got) == sorted((x[1], round(x[4], 9), round(x[5], 6)) for x in want)


def test_order_is_checked(spark):
    with pytest.raises(ValueError):
        lm.score(empty_docs(spark), order=4)
