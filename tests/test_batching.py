"""Batches by bytes against a sequential simulation; epochs; row splits of every level; nested payloads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import batching, paths, relational, stats, tensors
from gneiss.plans.features import Representation


def simulated(sizes, target, c=0):
    ids, n = [], 0
    for w in sizes:
        ids.append(n)
        c += w
        if c >= target:
            n, c = n + 1, 0
    return ids, n, c


@pytest.mark.parametrize("seed", range(6))
def test_fillings_compose(seed):
    rng = np.random.default_rng(seed)
    target = int(rng.choice([1, 7, 50, 400]))
    parts = [rng.integers(0, rng.choice([2, 9, 60, 900]), rng.integers(1, 60)) for _ in range(8)]
    whole, each = None, [batching.filling(p, target) for p in parts]
    for p, f in zip(parts, each):
        for c in range(target):
            _, n, held = simulated(p.tolist(), target, c)
            assert tuple(map(int, f(np.array(c)))) == (n, held)
        whole = f if whole is None else whole.then(f)
    right = each[-1]
    for f in each[-2::-1]:
        right = f.then(right)
    for c in range(target):
        _, n, held = simulated(np.concatenate(parts).tolist(), target, c)
        assert tuple(map(int, whole(np.array(c)))) == (n, held) == tuple(map(int, right(np.array(c))))


@pytest.mark.parametrize("spacing,target,weigh", [(1, 5000, False), (70_000, 5000, False), (1 << 33, 900, False), (40, 20 << 20, True), (1, 10**9, False)])
def test_batches_by_bytes(spark, spacing, target, weigh):
    rng = np.random.default_rng(spacing % 97)
    n = 20_000 if weigh else 3000
    sizes = np.where(rng.random(n) < 0.01, 30 * min(target, 10**6), rng.integers(0, 400, n))
    df = spark.createDataFrame([(int(i - n // 2) * spacing, int(w), "x") for i, w in enumerate(sizes)], "at long, bytes long, other string").repartition(5)
    got = sorted((r["at"], r.batch_id) for r in batching.batch_ids_by_bytes(df, "at", F.col("bytes"), target, weigh).collect())
    assert [b for _, b in got] == simulated(np.maximum(sizes, 2560 if weigh else 0).tolist(), target)[0]
    if weigh:
        assert np.bincount([b for _, b in got]).max() <= relational.MOST_ROWS


def test_batches_by_bytes_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, -3), (2, 5), (3, 5)], "at long, w long")
    got = batching.batch_ids_by_bytes(df, "at", F.col("w"), 10, False).orderBy("at", "w").collect()
    assert [(r["at"], r.batch_id) for r in got] == [(1, 0), (1, 0), (2, 0), (2, 0), (3, 1)]
    assert batching.batch_ids_by_bytes(df.limit(0), "at", F.col("w"), 10).count() == 0
    with pytest.raises(ValueError):
        batching.batch_ids_by_bytes(df, "at", F.col("w"), 0)


def test_epochs_are_permutations_wherever_rows_lie(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    make = lambda parts, seed, **o: relational.epoch_batches(df.repartition(parts), 64, 3, seed, ["id"], **o).orderBy("epoch", "position").collect()
    a, b, other = make(4, 5), make(16, 5), make(4, 6)
    assert a == b and a != other and len(a) == 3000
    orders = [[r.id for r in a if r.epoch == e] for e in range(3)]
    assert all(sorted(o) == list(range(1000)) for o in orders) and len({tuple(o) for o in orders}) == 3
    assert all(abs(np.corrcoef(np.arange(1000), o)[0, 1]) < 0.15 for o in orders)
    assert [r.position for r in a] == list(range(1000)) * 3 and [r.batch_id for r in a] == [i // 64 for i in range(3000)]
    dropped = make(4, 5, drop_final=True)
    assert dropped == a[: 3000 // 64 * 64]
    assert make(8, 5, first_batch=40) == a[40 * 64 :]  # what is left of a job that was stopped
    plain = relational.epoch_batches(df, 64, 2, None, ["id"]).orderBy("epoch", "position").collect()
    assert [r.id for r in plain] == list(range(1000)) * 2
    assert relational.epoch_batches(df, 64, 0, 1).count() == 0
    twice = relational.epoch_batches(df.unionAll(df), 10, 1, 3).orderBy("position").collect()
    assert [r.position for r in twice] == list(range(2000))
    with pytest.raises(ValueError):
        relational.epoch_batches(df, 64, 1, None, ["id", "v"])


def test_local_batches_go_on_over_epochs(spark):
    df = spark.range(10)
    sizes = lambda **o: [len(b) for b in relational.record_batches(df, **o)]
    assert sizes(batch_size=4, epochs=2) == [4] * 5 and sizes(batch_size=6, epochs=2) == [6, 6, 6, 2] and sizes(batch_size=7, epochs=2, drop_final=True) == [7, 7]
    a, b = ([r.id for batch in relational.record_batches(df.repartition(p), 4, epochs=2, shuffle=True, seed=9) for r in batch] for p in (2, 5))
    assert a == b and sorted(a[:10]) == sorted(a[10:]) == list(range(10)) and a[:10] != a[10:]
    assert list(relational.record_batches(df.limit(0), 4, epochs=None)) == []


def test_row_splits_of_every_level(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 40_000 - 500_000, None if i % 7 == 3 else [[[float(k)] * 2 for k in range(rng.integers(0, 3))] if rng.random() < 0.9 else [] for _ in range(rng.integers(0, 4))]) for i in range(60)]
    df = spark.createDataFrame(rows, "at long, v array<array<array<float>>>").repartition(4)

    def want(depth):
        lists, out = [v or [] for _, v in rows], {}
        for level in range(depth):
            ends = np.cumsum([len(x) for x in lists])
            out |= {(level, i + 1): int(e) for i, e in enumerate(ends)}
            lists = [x for y in lists for x in y]
        return out

    for uniform in (0, 1, 2):
        got = {(r.level, r.number): r.split for r in tensors.nested_row_splits(df, "v", "at", uniform).collect()}
        assert got == want(3 - uniform)
    with pytest.raises(TypeError):
        tensors.nested_row_splits(df, "v", "at", 3)


def test_ragged_splits_of_partitions(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6], [2, 1]), (2, [], []), (3, [7, 8], [0, 1])], "at long, v array<long>, n array<long>")
    r = Representation("ragged", ("v",), partitions=(("lengths", "n"), ("uniform", 2)))
    splits, inner = tensors.ragged_splits(df, r, "at")
    assert inner == [2] and sorted(map(tuple, splits.collect())) == [(0, 1, 2), (0, 2, 2), (0, 3, 4), (1, 1, 2), (1, 2, 3), (1, 3, 3), (1, 4, 4)]


def test_nested_payloads_fold(spark):
    kind = "struct<common:struct<n:long,hist:array<struct<low:double,count:double>>,empty:array<int>>,mean:double,tags:map<string,int>>"
    schema = f"slice string, feature_id string, is_path boolean, shard int, payload {kind}, custom array<struct<name:string,num:double>>"
    rows = [
        ("", "a", False, 2, ((None, [(3.0, 1.0)], None), None, {"x": 3, "z": None}), [("c", 3.0)]),
        ("", "a", False, 1, ((5, [(1.0, 2.0), (2.0, 2.0)], None), 1.5, {"x": 1, "y": 2}), None),
        ("", "a", False, 3, None, [("c", 4.0), ("d", 5.0)]),
        ("", "b", False, 1, None, None),
        ("", "a", True, 1, ((7, None, [1]), None, None), []),
    ]
    got = {(r.feature_id, r.is_path): r for r in stats.merge_statistics(spark.createDataFrame(rows, schema).repartition(3), payloads=["payload", "custom"], order="shard").collect()}
    a = got["a", False]
    assert a.payload.asDict(True) == {"common": {"n": 5, "hist": [{"low": x, "count": c} for x, c in ((1.0, 2.0), (2.0, 2.0), (3.0, 1.0))], "empty": None}, "mean": 1.5, "tags": {"x": 3, "y": 2, "z": None}}
    assert [tuple(x) for x in a.custom] == [("c", 3.0), ("c", 4.0), ("d", 5.0)]
    assert got["b", False].payload is None and got["b", False].custom is None
    assert got["a", True].payload.common.n == 7 and got["a", True].payload.common.empty == [1] and got["a", True].custom == []


def test_leaves_are_counted_in_one_walk(spark):
    df = spark.createDataFrame([(1, [([1, None], (2.0,)), (None, None)], "x"), (1, [None], None), (2, [], "y"), (3, None, "z")], "row long, a array<struct<b:array<int>,c:struct<d:double>>>, e string")
    out = paths.leaf_values(df, "row")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1
    got = {(r.path, r.row): (r.n_values, r.n_missing) for r in out.collect()}
    want = {}
    for path, _ in paths.enumerate_paths(df.drop("row").schema, True):
        for r in paths.get_array(df, path, "row").groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("m")).collect():
            want[str(path), r.row] = (r.n, r.m)
    assert got == want
