"""The classifier: held-out accuracy, a plain recomputation of its scores, and edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gneiss.llm import quality

from .fixtures import SF, edge_docs, empty_docs


@pytest.fixture(scope="module")
def model(spark):
    d = SF.replace("0.001", "0.01")
    return quality.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    d = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 = 0")
    r = quality.score(docs, model).join(labels, "doc_id").toPandas()
    assert len(r) > 500 and (r.predicted == r.quality).mean() > 0.98
    assert r[r.quality == 0].predicted.mean() < 0.1
    assert (r.predicted == (r.score >= 0.3)).all() and r.score.between(0, 1).all()


def test_scores_do_not_depend_on_the_batch(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    together = quality.scores(model, pa.array(texts))
    alone = np.concatenate([quality.scores(model, pa.array([t])) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_one_passage_by_hand(model):
    buf = np.frombuffer(b"Hello hello, you!\nHello hello, you!", np.uint8)
    x, first = quality.encode(buf, np.array([0, len(buf)]))
    assert first.tolist() == [0, 1]
    assert x[0, 0] == pytest.approx(np.sqrt(2 / len(buf))) and x[0, 4] == pytest.approx(np.sqrt(1 / len(buf)))
    c = quality.CLASSES.shape[1]
    assert x[0, c + 2] == pytest.approx(3 / 6) and x[0, c + 3] == pytest.approx(34 / 35)
    m = {k: v.astype(float) for k, v in model.items()}
    h = np.tanh((x[0] - m["mean"]) / m["std"] @ m["W"] + m["b"])
    assert quality.scores(model, pa.array([buf.tobytes().decode()]))[0] == pytest.approx(1 / (1 + np.exp(-(h @ m["c"] + m["d"]))), abs=1e-4)


def plain_features(raw):
    """A text's passage features, recomputed passage by passage and line by line."""
    size, out = quality.PASSAGE, []
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    lines, at = [], 0
    for line in low.split(b"\n"):
        if line:
            lines.append((at, line))
        at += len(line) + 1
    often = Counter(line for _, line in lines)
    inside = np.zeros(len(raw), bool)
    for a, line in lines:
        inside[a : a + len(line)] = often[line] > 1
    for a in range(0, max(1, len(raw)), size):
        part, f = raw[a : a + size], np.zeros(quality.N_FEATURES)
        n, c = max(1, len(part)), quality.CLASSES.shape[1]
        f[:c] = np.sqrt(sum((quality.CLASSES[b] for b in part), np.zeros(c)) / n)
        ws = low[a : a + size].split()
        if ws:
            f[c] = np.mean([len(w) for w in ws]) / 10
            f[c + 1] = np.mean([x == y for x, y in zip(ws, [None, *ws])])
            f[c + 2] = len(set(ws)) / len(ws)
        f[c + 3] = inside[a : a + size].sum() / n
        f[c + 4] = np.log1p(sum(a <= x < a + size for x, _ in lines)) / 4
        f[c + 5] = not raw
        out.append(f)
    return np.array(out)


def bag_texts():
    rng = np.random.default_rng(5)
    words = ["One", "two", "three,", "(four)", "f\u00fcnf", "SIX6", "\n", "seven seven", "line again\n", "\n\n"]
    return ["", "x", "same\nsame\nother", "a" * 3000, *(" ".join(rng.choice(words, n)) for n in (5, 90, 700, 2500)), "\n".join(["long " * 300] * 3)]


@pytest.mark.parametrize("size", [quality.SLICE, 600])
def test_bags_of_many_passages(model, monkeypatch, size):
    monkeypatch.setattr(quality, "SLICE", size)
    raws = [t.encode() for t in bag_texts()]
    x, first = quality.encode(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]))
    m = {k: v.astype(float) for k, v in model.items()}
    got = quality.scores(model, pa.array(bag_texts()))
    weights = 0
    for i, raw in enumerate(raws):
        want = plain_features(raw)
        assert np.allclose(x[first[i] : first[i + 1]], want, atol=1e-5), i
        h = np.array([np.tanh((f - m["mean"]) / m["std"] @ m["W"] + m["b"]) for f in want])
        e = np.array([np.exp(sum(m["w"] * np.tanh(v @ m["V"]) / (1 + np.exp(-(v @ m["U"]))))) for v in h])
        weights = max(weights, len(e) * (e / e.sum()).max())
        z = sum(a * v for a, v in zip(e / e.sum(), h))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(z @ m["c"] + m["d"]))), abs=1e-4)
    assert weights > 1.05  # the attention is not a plain mean


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(1)
    n, hidden, gate = quality.N_FEATURES, 5, 4
    m = {k: rng.normal(0, 0.4, shape) for k, shape in (("W", (n, hidden)), ("b", hidden), ("V", (hidden, gate)), ("U", (hidden, gate)), ("w", gate), ("c", hidden), ("d", ()))}
    m |= {"mean": rng.normal(size=n), "std": rng.uniform(0.5, 1, n)}
    x, at, y = rng.normal(size=(12, n)), np.array([0, 1, 5, 12]), np.array([1.0, 0.0, 1.0])
    loss = lambda m: -np.mean(np.log(np.where(y > 0, (p := quality._forward(m, x, at)[5]), 1 - p)))
    grad = quality.gradient(m, x, at, y)
    for k in grad:
        for i in [tuple(rng.integers(0, s) for s in m[k].shape) for _ in range(6)]:
            ends = []
            for step in (1e-5, -1e-5):
                moved = m[k].copy()
                moved[i] += step
                ends.append(loss(m | {k: moved}))
            assert grad[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-7), k


def test_bounds_of_the_sample(spark):
    """A row over max_bag passages is not trained on; a null id is in the result and not held out."""
    rows = [(i, ("Good prose, at length. " if i % 2 else "$$ ## 00 ") * (i + 3)) for i in range(8)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    long = [(8, "0" * (3 * quality.PASSAGE + 1))]
    of = lambda rows, **k: quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, None, **k)
    a, b, c = of(rows), of(rows + long, max_bag=3), of(rows + long, max_bag=4)
    assert all((a[k] == b[k]).all() for k in a) and any((a[k] != c[k]).any() for k in a)
    assert any((a[k] != v).any() for k, v in of(rows, max_passages=5).items())


def test_edges(spark, model):
    docs = edge_docs(spark)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] and by[9] == by[10]
    kept = quality.keep(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in got)
    assert quality.score(empty_docs(spark), model).count() == 0


def test_no_labels(spark):
    docs = edge_docs(spark)
    for rows, want in (([], 0.5), ([(4, 1), (5, 1), (None, 0), (6, None)], 1.0)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert {r.score for r in quality.score(docs, quality.learn(docs, labels, held_out=None)).collect()} == {want}


def test_repeated_ids_train_once_in_any_order(spark):
    rows = [(7, f"row {i} of a frequent id " * 3) for i in range(60)] + [(i, ("Good prose, at length. " if i % 2 else "$$ ## 00 ") * (i + 3)) for i in range(4)]
    labels = spark.createDataFrame([(7, 1), *[(i, i % 2) for i in range(4)]], "doc_id long, quality int")
    models = [quality.learn(spark.createDataFrame(x, "doc_id long, text string").coalesce(n), labels, None, 5) for x, n in ((rows, 1), (rows[::-1], 1), (rows[::2] + rows[1::2], 3))]
    once = [min((r for r in rows if r[0] == 7), key=lambda r: hashlib.sha256(r[1].encode()).digest()), *rows[60:]]
    models.append(quality.learn(spark.createDataFrame(once, "doc_id long, text string"), labels, None, 5))
    for m in models:
        assert "constant" not in m and all((m[k] == models[0][k]).all() for k in m)
