"""Graph search against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from gneiss.llm import ann

VEC = "vec_id long, embedding array<float>, label int, ids string"


def brute(rows, k=20):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(ok))
    m = np.array([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = m @ ok[q]
        out[q] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VEC)
    out = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hit = sum(len({x for x, _ in got.get(q, [])} & {x for x, _ in w}) for q, w in want.items())
    return hit / max(1, sum(len(w) for w in want.values()))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (6000, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.95
    for q, g in got.items():
        for i, s in g:
            assert s == pytest.approx(float(np.dot(x[q].astype(float), x[i].astype(float))), abs=1e-12)
        assert g == sorted(g, key=lambda y: (-y[1], y[0]))


def direct(n, dim, kind, rng):
    x = rng.normal(size=(n, dim))
    if kind == "clusters":
        x = rng.normal(size=(200, dim))[rng.integers(0, 200, n)] + 0.8 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    low, high = {"near": (0.9, 1.1), "wide": (0.5, 2)}.get(kind, (1, 1))
    return (x * rng.uniform(low, high, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("kind", ["unit", "near", "wide", "clusters"])
@pytest.mark.parametrize("dim", [64, 128])
def test_recall_at_full_shards(spark, monkeypatch, kind, dim):
    """Shards of 8,192 vectors, whatever the norms are."""
    monkeypatch.setattr(ann, "LEAST_SHARDS", 1)
    n = 24_576
    x = direct(n, dim, kind, np.random.default_rng(dim))
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0 and vec_id < 2000"), shard_rows=8192).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    score = x[:2000:20].astype(float) @ x.T.astype(float)
    score[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    want = {20 * i: [(int(j), 0) for j in np.argpartition(-s, 20)[:20]] for i, s in enumerate(score)}
    assert len(got) == 100 and recall(got, want) >= 0.95


@pytest.mark.parametrize("kind,dim", [("lognormal 1", 64), ("lognormal 2", 128), ("pareto", 64), ("mean", 64), ("mean", 128)])
def test_recall_of_heavy_tails_and_common_means(spark, kind, dim):
    """Default parameters, all stated queries."""
    n, rng = 30_000, np.random.default_rng(dim)
    x = rng.normal(size=(n, dim))
    if kind == "mean":
        x = x * np.linspace(1, 0.1, dim) + 2 * rng.normal(size=dim)
    else:
        norm = 1 + rng.pareto(1.2, n) if kind == "pareto" else rng.lognormal(0, float(kind.split()[1]), n)
        x *= (norm / np.linalg.norm(x, axis=1))[:, None]
    x = x.astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))}))
    found = ann.search(df, df.where("vec_id % 20 = 0")).toPandas().groupby("query_id")["vec_id"].agg(set)
    hit, wide = 0, x.astype(float)
    for q in range(0, n, 20):
        score = wide @ wide[q]
        score[q] = -np.inf
        hit += len(found[q] & set(np.argpartition(-score, 20)[:20].tolist()))
    assert hit / (n // 20 * 20) >= 0.95


def test_every_point_can_be_reached():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1500, 8)), np.repeat(rng.normal(size=(1, 8)), 300, 0) + 1e-3 * rng.normal(size=(300, 8))]).astype(np.float32)
    for degree in (2, 5, 40):
        graph, entry = ann.build_graph(x, degree=degree)
        seen, frontier = np.zeros(len(x) + 1, bool), np.asarray(entry)
        while len(frontier):
            seen[frontier] = True
            frontier = np.unique(graph[frontier])
            frontier = frontier[~seen[frontier]]
        assert seen[:-1].all()


def test_queries_visit_few_groups_of_clustered_vectors(spark, monkeypatch):
    """Routing is calibrated: clustered vectors need few of the groups, and crowded groups are split."""
    monkeypatch.setattr(ann, "LEAST_SHARDS", 1)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.repeat(rng.normal(size=(64, 16)), 60, 0), np.repeat(rng.normal(size=(1, 16)), 2000, 0)]) + 0.1 * rng.normal(size=(5840, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    seen = []
    whole = ann.Router.order
    monkeypatch.setattr(ann.Router, "order", lambda self, v: seen.append((self.probes, self.groups, self.shards.max())) or whole(self, v))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VEC)
    probes = []
    calibrated = ann._calibrated
    monkeypatch.setattr(ann, "_calibrated", lambda *a: probes.append(calibrated(*a)) or probes[-1])
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), shard_rows=100).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(got, brute(rows)) >= 0.95
    assert probes[0] < seen[0][1] / 4 and seen[0][2] > 1


def test_few_groups_are_calibrated_too(spark, monkeypatch):
    """One rule for every size: small tables of few groups are routed as large ones are."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(8, 16)), 100, 0)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) + 0.01 * rng.normal(size=x.shape)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    seen, calibrated = [], ann._calibrated
    monkeypatch.setattr(ann, "_calibrated", lambda points, queries, router, *a: seen.append((calibrated(points, queries, router, *a), int((router.most > 0).sum()))) or seen[-1][0])
    assert recall(run(spark, rows), brute(rows)) >= 0.95
    assert seen[0][0] < seen[0][1] <= 16


def test_groups_of_one_vector(spark):
    """Vectors in more bands than are calibrated: a query visits groups until they hold k others."""
    rows = [(20 * i, [float(np.float32(1.5**i))]) for i in range(21)]
    assert run(spark, rows) == brute(rows)
    rows = [(20 * i, [2.0**i if i < 40 else -(2.0 ** (i - 60))]) for i in range(19)]
    assert run(spark, rows) == brute(rows)


def test_dimensions_and_extreme_norms(spark):
    rows = [(20, [1.0, 2.0]), (1, [1e-30, 1e-30]), (2, [3e38, 3e38]), (3, [1.0]), (40, [1.0, 1.0, 1.0]), (4, [-1.0, -2.0]), (20, [1.0, 2.0])]
    assert [i for i, _ in run(spark, rows)[20]] == [2, 1, 4] and run(spark, rows).keys() == {20}


def test_bad_vectors_copies_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (20, [0.0, 2.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0])]
    got = run(spark, rows)
    assert got == {0: [(7, 1.0), (20, 0.0)], 20: [(7, 2.0), (0, 0.0)]}
    copies = [(i, [1.0, 0.5]) for i in range(100)] + [(i, [0.25, 0.125 * i]) for i in range(100, 120)]
    assert run(spark, copies) == brute(copies)


def test_empty(spark):
    assert run(spark, [(0, None)]) == {}
    df = spark.createDataFrame([], VEC)
    assert ann.search(df, df).count() == 0
