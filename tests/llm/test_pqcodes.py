"""Vector codes against plain Lloyd rounds over integers, and their SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from gneiss.llm import pqcodes

from .fixtures import SF

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows of (vec_id, embedding, label) by the definition, in Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    dims = [len(r[1]) for r in kept]
    dim = min(set(dims), key=lambda d: (-dims.count(d), d))
    kept = [r for r in kept if len(r[1]) == dim]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = [[math.floor(x * 256) for x in r[1]] for r in kept]
    cuts = [p * dim // parts for p in range(parts + 1)]
    cut = lambda v, p: v[cuts[p] : cuts[p + 1]]
    books = [[cut(v, p) for v in q[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [near(cut(v, p), book)[0] for v in q]
            for e in set(of):
                mine = [cut(v, p) for v, o in zip(q, of) if o == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, errors = [], {}
    for r, v in zip(kept, q):
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        errors[r[2]] = errors.get(r[2], 0) + error
        out.append((r[0], "".join(f"{c:02x}" for c, _ in found), error, r[2]))
    return [(i, code, error, errors[label], sha) for i, code, error, label in out]


def check(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(repr, map(tuple, pqcodes.compress(df, **kw).collect())))
    assert got == sorted(map(repr, brute([tuple(r[:3]) for r in rows], **kw)))


def test_ordinary_vectors(spark):
    x = np.random.default_rng(1).normal(0, 0.2, (700, 32))
    check(spark, [(int(i * 7 % 1000), v.tolist(), i % 5 if i % 11 else None) for i, v in enumerate(x)])


def test_ties_and_repeated_rows(spark):
    """Few distinct small integers: nearly every part is as near to several entries."""
    x = np.random.default_rng(2).integers(-2, 3, (500, 32)) / 256
    rows = [(i // 2, v.tolist(), 0) for i, v in enumerate(x)]
    check(spark, rows + rows[:40])
    check(spark, [(i, [0.5] * 16, 1) for i in range(100)])


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = np.random.default_rng(3).normal(0, 1, (90, 16)).tolist()
    rows = [(i, v, i % 3) for i, v in enumerate(good)]
    rows += [(-1, None, 0), (-2, [], 0), (-3, [nan] * 16, 0), (-4, [1.0] * 15 + [inf], 0), (-5, [None] + [1.0] * 15, 0), (-6, [1.0] * 15, 0), (-7, [0.0] * 16, 0)]
    rows += [(None, [0.25] * 16, None), (None, [0.25] * 16, None)]
    check(spark, rows)
    df = spark.createDataFrame([], SCHEMA)
    assert pqcodes.compress(df).count() == 0
    assert pqcodes.compress(spark.createDataFrame(rows[90:96][:5], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim,parts,entries,rounds,n", [(10, 4, 5, 4, 300), (7, 16, 3, 2, 50), (32, 2, 256, 1, 300), (16, 16, 1, 2, 20), (16, 16, 64, 0, 80), (16, 16, 64, 2, 9)])
def test_parameters(spark, dim, parts, entries, rounds, n):
    x = np.random.default_rng(n).standard_cauchy((n, dim)).clip(-500, 500)
    check(spark, [(i, v.tolist(), i % 2) for i, v in enumerate(x)], parts=parts, entries=entries, rounds=rounds)


def test_large_components_stay_exact(spark):
    x = np.random.default_rng(4).normal(0, 100_000, (300, 16))
    check(spark, [(i, v.tolist(), i % 2) for i, v in enumerate(x)])
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i] * 16, 0) for i in range(3)], SCHEMA)
    assert [r.error for r in pqcodes.compress(huge).collect()] == [0, 0, 0]


def test_bounds_skip_scans_and_keep_assignments():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (16, 8))
    q = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 5, (4000, 8))).astype(np.int64)
    cuts = [0, 4, 8]
    books = pqcodes.Books([q[:24, :4], q[:24, 4:]])
    state = pqcodes.assign(cuts, q, books, None)
    assert state.scanned == 8000
    for _ in range(6):
        moved, new = [], []
        for p, book in enumerate(books.entries):
            new.append(np.array([q[state.code[:, p] == e, 4 * p : 4 * p + 4].sum(0) // max(1, (state.code[:, p] == e).sum()) if (state.code[:, p] == e).any() else book[e] for e in range(24)]))
            moved.append(pqcodes._sqrt_up(((new[-1] - book) ** 2).sum(1)))
        books = pqcodes.Books(new, moved)
        state = pqcodes.assign(cuts, q, books, state)
        for p, book in enumerate(books.entries):
            near, best, second = pqcodes.scan(q[:, cuts[p] : cuts[p + 1]], book)
            assert (near == state.code[:, p]).all()
            assert (state.upper[:, p].astype(float) ** 2 >= best * (1 - 1e-9)).all() and (np.maximum(state.lower[:, p], 0).astype(float) ** 2 <= second * (1 + 1e-9)).all()
    assert state.scanned < 4000


def test_sums_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(pqcodes, "HEAVY", 3)
    rows = [(i, i % 7 if i % 5 else None, i * i) for i in range(200)] + [(i, 99, 2**62) for i in range(200, 203)]
    df = spark.createDataFrame(rows, "i long, label int, error long")
    sums = {}
    for _, label, error in rows:
        sums[label] = min(pqcodes.LONG, sums.get(label, 0) + error)
    got = {r.i: r.total for r in pqcodes.with_group_sum(df, "label", "error", "total").collect()}
    assert got == {i: sums[label] for i, label, _ in rows}


def test_columns_and_kinds(spark):
    rows = [(i, [float(i)] * 16, "ab"[i % 2], "clash", 1) for i in range(70)]
    check(spark, rows, "vec_id long, embedding array<float>, label string, part string, n int")


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    df = pqcodes.op13_vector_codes(spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({pqcodes.OP13_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
