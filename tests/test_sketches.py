"""Distinct counts, heavy hitters and quantiles: exact vectors, error bounds, merging."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.operators import distinct, heavy, quantiles, sketches


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize("kind,values", [("string", ["a", "a", "b", "c", None]), ("int", [1, 1, 2, 3, None]), ("double", [1.0, 1.0, 2.0, 3.0, None]), ("binary", [b"a", b"a", b"b", b"c", None])])
def test_distinct_small(spark, kind, values):
    df = frame(spark, values, kind)
    assert distinct.kmv(df, "v").select(distinct.kmv_estimate()).first()[0] == 3
    assert distinct.theta_sketch(df, "v").select(distinct.theta_estimate()).first()[0] == 3
    assert distinct.distinct_exact(df, "v").first()[0] == 3


def test_distinct_kinds(spark):
    with pytest.raises(TypeError):
        distinct.kmv(frame(spark, [True], "boolean"), "v")
    text = distinct.kmv(frame(spark, ["a"]), "v").first().hashes
    assert text == distinct.kmv(frame(spark, [b"a"], "binary"), "v").first().hashes
    assert distinct.kmv(frame(spark, [0.1], "float"), "v").first().hashes != distinct.kmv(frame(spark, [0.1], "double"), "v").first().hashes


def test_distinct_merge_and_error(spark):
    a, b = frame(spark, ["a", "b", "c", "a"]), frame(spark, ["d", "a"])
    both = distinct.kmv(a, "v").unionAll(distinct.kmv(b, "v"))
    assert distinct.kmv_merge(both).select(distinct.kmv_estimate()).first()[0] == 4
    big = spark.range(20_000).select(F.col("id").cast("string").alias("v"), (F.col("id") % 3).alias("g"))
    for r in distinct.kmv(big, "v", 512, ["g"]).withColumn("n", distinct.kmv_estimate(512)).collect():
        assert len(r.hashes) == 512 and abs(r.n / 6667 - 1) < 4 / math.sqrt(512)
    whole = distinct.kmv(big, "v", 512).first().hashes
    parts = distinct.kmv_merge(distinct.kmv(big, "v", 512, ["g"]), 512).first().hashes
    assert whole == parts


def test_top_k(spark):
    w = spark.createDataFrame([("a", 4.0), ("a", 3.0), ("b", 2.0), ("c", 1.0), (None, 9.0), ("b", float("nan"))], "v string, w double")
    assert [tuple(r) for r in heavy.top_k(w, "v", 3, "w").collect()] == [("a", 7.0), ("b", 2.0), ("c", 1.0)]
    t = frame(spark, ["a", "a", "b", "c"])
    assert [tuple(r) for r in heavy.top_k(t, "v", 3, reverse_ties=True).collect()] == [("a", 2.0), ("c", 1.0), ("b", 1.0)]
    m = frame(spark, ["a", "b", "c", "a", "d", "a"])
    assert [tuple(r) for r in heavy.top_k(m, "v", 4).collect()] == [("a", 3.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)]


def test_clean_text(spark):
    df = spark.createDataFrame([(b,) for b in [b"a", b"\x80", b"\xc1", b"\xc0\x80", b"a", b"a", b"\xff"]], "v binary")
    got = heavy.top_k(df, heavy.clean_text("v"), 4).collect()
    assert [tuple(r) for r in got] == [("__INVALID__", 4.0), ("a", 3.0)]
    df = frame(spark, ["a", "bbb", "c", "d", "eeff", "a", "gghh", "a", "iii"])
    got = heavy.top_k(df, heavy.clean_text("v", threshold=2), 4).collect()
    assert [tuple(r) for r in got] == [("__LARGE__", 4.0), ("a", 3.0), ("c", 1.0), ("d", 1.0)]


def test_misra_gries_object():
    m = heavy.MisraGries(3).add(pd.Series(["a", "b", "c", "a", None])).merge(heavy.MisraGries(3).add(pd.Series(["b", "a"])))
    assert m.estimate() == [("a", 3.0), ("b", 2.0), ("c", 1.0)] and m.delta == 0
    assert heavy.MisraGries(4).add(pd.Series(["b", "a"])).estimate(reverse_ties=True) == [("b", 1.0), ("a", 1.0)]
    with pytest.raises(ValueError):
        heavy.MisraGries(3).merge(heavy.MisraGries(2))


def test_misra_gries_bound(spark):
    rng = random.Random(4)
    values = [min(int(rng.paretovariate(1.1)), 5000) for _ in range(20_000)]
    df = frame(spark, values, "int").repartition(6)
    exact = {v: values.count(v) for v in set(values[:2000])}
    got = heavy.misra_gries(df, "v", 50).collect()
    assert 0 < len(got) <= 50
    for r in got:
        if r.value in exact:
            assert exact[r.value] - 1e-6 <= r["count"] <= exact[r.value] + r.delta + 1e-6
    assert all(r.delta <= 2 * len(values) / 51 for r in got)
    assert max(exact, key=exact.get) in {r.value for r in got}


def q(spark, rows, n, weighted=True):
    df = spark.createDataFrame(rows, "v double, w double") if weighted else spark.createDataFrame([(float(v),) for v in rows], "v double")
    got = quantiles.quantiles(df, "v", n, "w" if weighted else None).orderBy("r").collect()
    return [r.quantile for r in got], [r.cum_weight for r in got]


def test_quantile_vectors(spark):
    assert q(spark, range(1, 301), 5, False) == ([1, 61, 121, 181, 241, 300],) * 2
    assert q(spark, [1, 2, 3, 4, 2, 2, 2, 2, 1, 2, 3, 4], 3, False) == ([1, 2, 3, 4], [2, 8, 10, 12])
    assert q(spark, [0] * 100, 3, False) == ([0] * 4, [100] * 4)
    rows = [(float(i), float(1 + (i - 1) // 100)) for i in range(1, 301)] + [(-100.0, float("nan")), (float("nan"), 10000.0), (1e9, 0.0), (-1e9, -1.0), (None, 5.0)]
    assert q(spark, rows, 5) == ([1, 111, 171, 221, 261, 300], [1, 122, 242, 363, 483, 600])
    inf = float("inf")
    assert q(spark, [1.0, 2.0, inf, inf, inf, -inf, -inf, -inf, 3.0, 4.0], 5, False)[0] == [-inf, -inf, 2, 4, inf, inf]
    assert q(spark, [], 4, False) == ([], [])
    with pytest.raises(ValueError):
        quantiles.quantiles(frame(spark, [1.0], "double"), "v", 1)


def test_quantiles_against_the_definition(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice([rng.gauss(0, 1), float(rng.randrange(5))]), float(rng.randrange(1, 5))) for g in "ab" for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {(r.g, r.r): (r.quantile, r.cum_weight) for r in quantiles.quantiles(df, "v", 9, "w", ["g"], side=3).collect()}
    for g in "ab":
        values = sorted({v for a, v, _ in rows if a == g})
        weight = {v: sum(w for a, x, w in rows if a == g and x == v) for v in values}
        total, cum, at = sum(weight.values()), 0.0, []
        for v in values:
            cum += weight[v]
            at.append((v, cum))
        for r in range(10):
            want = next(((v, c) for v, c in at if c > r * total / 9), at[-1])
            assert got[g, r] == want
    assert len(got) == 20


def test_approximate(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    for eps in (0.1, 0.01):
        got = quantiles.approximate(df, "v", 10, eps).first().quantiles
        assert all(abs(x - i * 1000) <= eps * 10_000 + 1 for i, x in enumerate(got))
    parts = quantiles.kll(df.withColumn("g", F.col("v") % 4), "v", by=["g"])
    median = quantiles.kll_merge(parts).select(F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).first()[0]
    assert abs(median - 5000) < 300
    assert quantiles.boundaries(df, "v", 4).first().quantiles == [0, 2500, 5000, 7500, 9999]


def test_weighted_sketches_merge(spark):
    """Stored, merged and cut back, ranks stay within eps; values without weight don't count; empty groups have none."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(int(i % 7), int(i % 2), float(v), float(w)) for i, (v, w) in enumerate(zip(rng.lognormal(0, 2, 6000), rng.integers(-1, 9, 6000)))]
    df = spark.createDataFrame(rows, "day int, g int, v double, w double")
    eps = 0.05
    stored = quantiles.sketch(df, "v", eps, "w", ["day", "g"])
    assert stored.schema["sketch"].dataType.simpleString() == "binary" and stored.count() == 14
    for sketches in (quantiles.sketch_merge(stored.drop("day"), ["g"]), quantiles.sketch_compact(quantiles.sketch_merge(stored.drop("day"), ["g"]), eps, ["g"])):
        for r in quantiles.sketch_quantiles(sketches, 10, ["g"]).collect():
            mine = [(v, w) for _, g, v, w in rows if g == r.g and w > 0]
            whole = sum(w for _, w in mine)
            low, high = (sum(w for v, w in mine if v < r.quantile), sum(w for v, w in mine if v <= r.quantile))
            assert low <= (r.r / 10 + eps) * whole and high >= (r.r / 10 - eps) * whole
    assert quantiles.sketch(df.where("w <= 0"), "v", eps, "w").count() == 0


def test_summaries_of_heavy_values_merge(spark):
    rows = [(i % 5, f"v{min(i % 97, i % 13)}", 1.0 + i % 3) for i in range(3000)] + [(0, None, 1.0), (0, "x", -1.0)]
    df = spark.createDataFrame(rows, "day int, v string, w double")
    for k in (4, 100):
        merged = heavy.summary_merge(heavy.summary(df, "v", k, "w", ["day"]).drop("day"))
        true: dict = {}
        for _, v, w in rows:
            if v is not None and w > 0:
                true[v] = true.get(v, 0) + w
        got = heavy.summary_counts(merged).collect()
        assert 0 < len(got) <= k
        for r in got:
            assert true[r.value] - 1e-9 <= r["count"] <= true[r.value] + r.delta + 1e-9 and r.delta <= sum(true.values()) / (k + 1)
    both = heavy.summary(df, "v", 4).unionAll(heavy.summary(df, "v", 5))
    with pytest.raises(Exception, match="different sizes"):
        heavy.summary_counts(heavy.summary_merge(both)).collect()
    with pytest.raises(ValueError):
        heavy.summary(df, "v", 0)


def _rank_error(v, w, q, n):
    """The largest distance of boundary r's true ranks from r / n, as a share of the weight."""
    total, worst = w.sum(), 0.0
    for r, x in enumerate(q):
        below, upto, want = w[v < x].sum() / total, w[v <= x].sum() / total, r / n
        worst = max(worst, below - want, want - upto)
    return worst


@pytest.mark.parametrize("eps", [0.05, 0.005])
def test_streams_hold_their_error_and_size(eps):
    rng = np.random.default_rng(1)
    n = 300_000
    for v, w in (
        (np.arange(n, 0, -1.0), np.arange(n) + 1.0),  # values fall while weights grow
        (rng.normal(size=n), rng.pareto(0.8, n) + 1e-3),
        (np.sort(rng.integers(0, 50, n).astype(float)), np.ones(n)),
        (rng.random(n), np.where(rng.random(n) < 1e-4, 1e6, 1e-6)),
    ):
        stream, held = sketches.Stream(eps), 0
        for i in range(0, n, 7000):
            stream.add(v[i : i + 7000], w[i : i + 7000])
            held = max(held, stream.held)
        whole = stream.result()
        assert held <= stream.size * (len(stream.levels) + 4) + 7000
        assert whole.error() <= eps
        cut = whole.fit(2 * eps)
        assert cut.error() <= 2 * eps + 1e-12 and len(cut) <= 2 / eps + 2
        assert np.isclose(cut.total, w.sum())
        for ranks, bound in ((whole, eps), (cut, 2 * eps)):
            q, upto = ranks.quantiles(37)
            assert _rank_error(v, w, q, 37) <= bound + 1e-9
            assert q[-1] == v.max() and np.isclose(upto[-1], w.sum())


def test_small_sketches_are_exact(spark):
    rows = [(None, 1.0), (3.0, 2.0), (1.0, 1.0), (float("nan"), 9.0), (2.0, 0.0), (5.0, 4.0), (1.0, 1.0), (4.0, None), (7.0, -1.0)]
    df = spark.createDataFrame(rows, "v double, w double")
    got = [tuple(r) for r in quantiles.sketch_quantiles(quantiles.sketch(df, "v", 1e-5, "w"), 4).collect()]
    assert sorted(got) == sorted(tuple(r) for r in quantiles.quantiles(df, "v", 4, "w").collect())
    assert quantiles.sketch(df.limit(0), "v", 0.1).count() == 0
    with pytest.raises(ValueError):
        quantiles.sketch(df, "v", 0.0)
    with pytest.raises(ValueError):
        sketches.Ranks.from_bytes(b"no sketch at all")


def test_sketches_merge_by_group_without_shuffling_values(spark):
    rng = np.random.default_rng(2)
    n, eps = 60_000, 0.01
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 5, n))  # one group holds most rows
    v, w = rng.normal(size=n) * (g + 1), rng.pareto(1.1, n) + 0.01
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v, "w": w, "day": np.arange(n) % 9})).repartition(6)
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))  # null is a group
    made = quantiles.sketch(df, "v", eps, "w", ["g", "day"])
    for _ in range(3):  # merging doesn't use eps up
        made = quantiles.sketch_merge(made, ["g", "day"])
    merged = quantiles.sketch_merge(made.drop("day"), ["g"])
    for out in (merged, quantiles.sketch_compact(merged, eps, ["g"]), quantiles.sketch(df, "v", eps, "w", ["g"])):
        got = {}
        for r in quantiles.sketch_quantiles(out, 20, ["g"]).collect():
            got.setdefault(r.g or 0, []).append((r.r, r.quantile))
        assert sorted(got) == [0, 1, 2, 3, 4]
        for k, q in got.items():
            assert _rank_error(v[g == k], w[g == k], [x for _, x in sorted(q)], 20) <= eps
    plan = quantiles.sketch(df.drop("day"), "v", eps, "w", ["g"])._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        assert "Exchange" not in line or "_salt" in line or "hashpartitioning(g" in line or "RoundRobin" in line
    assert plan.index("_weight") > plan.index("_salt")  # values stand below the first shuffle only


def test_sketches_of_several_columns(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as a", "1000.0 - id as b", "id + 1.0 as w")
    got = quantiles.sketch_quantiles(quantiles.stream_sketches(df, ["a", "b"], 1e-4, "w"), 4, ["stream"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quantiles.streams(df, ["a", "b"], 4, "w").collect()))


def test_tasks_with_many_groups_give_out_early(spark, monkeypatch):
    monkeypatch.setattr(sketches, "HELD", 500)
    df = pd.DataFrame({"g": np.arange(6000) % 300, "v": np.arange(6000.0)})
    out = []
    batches = [pa.RecordBatch.from_pandas(df.iloc[i : i + 400].assign(_value=df.v, _weight=1.0)[["g", "_value", "_weight"]], preserve_index=False) for i in range(0, 6000, 400)]
    for b in sketches.rank_sketches(["g"], 0.1)(iter(batches)):
        out += zip(b.column("g").to_pylist(), b.column("sketch").to_pylist())
    assert len(out) > 600
    totals = {}
    for g, s in out:
        totals[g] = totals.get(g, 0) + sketches.Ranks.from_bytes(s)[0].total
    assert totals == dict.fromkeys(range(300), 20.0)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_counters_are_bounded(k):
    rng = np.random.default_rng(k)
    n = 50_000
    g, v, w = rng.integers(0, 3, n), rng.zipf(1.3, n).clip(max=10_000).astype(str).astype(object), rng.pareto(1.0, n) + 0.01
    t = pa.table({"g": g, "value": pa.array([x.encode() for x in v], pa.binary()), "count": w})
    rows, sizes = {}, 0
    for b in sketches.counter_rows(["g"], k)(iter(t.to_batches(max_chunksize=3000))):
        for r in b.to_pylist():
            rows[r["g"], r["value"]] = rows.get((r["g"], r["value"]), 0) + r["count"]
            sizes += 1
    assert sizes <= 3 * (k + 1)
    for group in range(3):
        true = pd.Series(w[g == group]).groupby(v[g == group]).sum()
        delta = rows.get((group, None), 0.0)
        assert delta <= true.sum() / (k + 1) + 1e-6
        for x, total in true.items():
            held = rows.get((group, x.encode()), 0.0)
            assert held <= total + 1e-6 <= held + delta + 2e-6


def test_summaries_by_group(spark):
    rng = np.random.default_rng(7)
    n, k = 40_000, 25
    g = rng.integers(0, 4, n)
    v, w = rng.zipf(1.4, n).clip(max=5000), rng.random(n)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v, "w": w})).withColumn("g", F.when(F.col("g") > 0, F.col("g"))).repartition(5)
    whole = heavy.summary(df, "v", k, "w", ["g"])
    days = heavy.summary_merge(heavy.summary(df.withColumn("d", F.col("v") % 3), "v", k, "w", ["g", "d"]).drop("d"), ["g"])
    for out in (whole, days):
        got = {}
        for r in heavy.summary_counts(out, ["g"]).collect():
            got.setdefault(r.g or 0, {})[int(r.value)] = (r["count"], r.delta)
        for group in range(4):
            true = pd.Series(w[g == group]).groupby(v[g == group]).sum()
            assert len(got[group]) == k
            for x, (count, delta) in got[group].items():
                assert delta <= true.sum() / (k + 1) + 1e-6 and true[x] - 1e-6 <= count <= true[x] + delta + 1e-6
            assert set(true[true > true.sum() / (k + 1)].index) <= set(got[group])
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") < plan.index("MapInArrow") or plan.count("RoundRobin")  # only counters are shuffled by key


def test_counters_that_tie_with_the_cut_stay(spark):
    """Three counters: merged summaries give three values, whatever ties with the last one."""
    parts = [["a"] * 3 + ["b"] * 2 + ["c", "d"], ["e"] * 3 + ["f"] * 2 + ["g", "h"], ["i"] * 2 + ["j", "k", "l"]]
    sets = [heavy.summary(spark.createDataFrame([(x,) for x in p], "v string").coalesce(1), "v", 3) for p in parts]
    merged = heavy.summary_merge(heavy.summary_merge(sets[0].unionAll(sets[1])).unionAll(sets[2]))
    got = sorted((r.value, r["count"]) for r in heavy.summary_counts(merged).collect())
    assert [x for _, x in got] == [5.0] * 3 and {"a", "e"} <= {v for v, _ in got}
    tie = [heavy.summary(spark.createDataFrame([(x,) for x in p], "v string").coalesce(1), "v", 3) for p in ("aaaaabbbbbccccaaaa", "ddddaa")]
    got = sorted((-r["count"], r.value) for r in heavy.summary_counts(heavy.summary_merge(tie[0].unionAll(tie[1]))).collect())
    assert got[:2] == [(-11.0, "a"), (-5.0, "b")] and got[2] in ((-4.0, "c"), (-4.0, "d")) and len(got) == 3
