"""Statistics merging and input profiles."""

import pytest
from pyspark.sql import functions as F

from gneiss.operators import profile, stats

SHARD = "slice string, num_examples long, weighted_num_examples double, feature_id string, is_path boolean, type string, stats_kind string, derived string, n long, custom array<string>, last double, o int"


def shards(spark, rows):
    full = [dict(slice="s", num_examples=0, weighted_num_examples=0.0, feature_id="f", is_path=False, type="INT", stats_kind="", derived=None, n=0, custom=None, last=None, o=i) | r for i, r in enumerate(rows)]
    order = [c.strip().split()[0] for c in SHARD.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in full], SHARD)


def merged(spark, rows):
    df = stats.merge_statistics(shards(spark, rows), sums=["n"], lists=["custom"], last=["last"], order="o")
    return [r.asDict() for r in df.orderBy("slice", "feature_id", "is_path").collect()]


def test_one_feature_over_shards(spark):
    got = merged(spark, [dict(num_examples=5, n=2, custom=["a"], last=1.0), dict(type="FLOAT", n=3, custom=["b", "c"], last=2.0), dict(num_examples=5, stats_kind="num", weighted_num_examples=2.5)])
    assert got == [dict(slice="s", feature_id="f", is_path=False, num_examples=5, weighted_num_examples=2.5, type="FLOAT", stats_kind="num", derived=None, n=5, custom=["a", "b", "c"], last=2.0)]


def test_slices_and_ids_stay_apart(spark):
    assert len(merged(spark, [dict(slice="a"), dict(slice="b"), dict(feature_id="g"), dict(is_path=True), dict(slice="a")])) == 4


@pytest.mark.parametrize("a,b", [(dict(num_examples=1), dict(num_examples=2)), (dict(weighted_num_examples=1.0), dict(weighted_num_examples=2.0)), (dict(type="FLOAT"), dict(type="STRING")), (dict(stats_kind="num"), dict(stats_kind="string")), (dict(derived="x"), dict(derived="y"))])
def test_conflicts(spark, a, b):
    with pytest.raises(Exception, match="shards disagree"):
        merged(spark, [a, b])


def test_cross(spark):
    rows = [("s", "a", "b", 3, "num"), ("s", "a", "b", 0, ""), ("s", "b", "a", 4, "num")]
    df = spark.createDataFrame(rows, "slice string, path_x string, path_y string, count long, stats_kind string")
    assert sorted(r["count"] for r in stats.merge_cross_statistics(df).collect()) == [3, 4]
    bad = df.union(spark.createDataFrame([("s", "a", "b", 9, "num")], df.schema))
    with pytest.raises(Exception, match="cross count"):
        stats.merge_cross_statistics(bad).collect()


def test_lists_and_accumulator(spark):
    s = shards(spark, [dict(n=1), dict(n=2)])
    lists = s.groupBy("slice").agg(F.collect_list(F.struct(*s.columns)).alias("all"))
    assert stats.merge_lists(lists, "all", sums=["n"]).first().n == 3
    acc = stats.Accumulator()
    acc.merge(s)
    acc.merge(shards(spark, [dict(n=4)]))
    assert acc.get(spark, sums=["n"]).first().n == 7
    with pytest.raises(RuntimeError):
        acc.get(spark)
    assert stats.Accumulator().get(spark).count() == 1 and stats.Accumulator(empty_placeholder=False).get(spark).count() == 0
    empty = stats.Accumulator()
    empty.merge(s.limit(0))
    assert empty.get(spark, sums=["n"]).count() == 1
    with pytest.raises(NotImplementedError):
        stats.Accumulator(version=1)


def test_profile(spark):
    rows = [(["abc", "def"], [1], [1.0]), (None, [2], []), (["g"], [3], []), ([], [4], [0.5])]
    df = spark.createDataFrame(rows, "f1 array<string>, f2 array<bigint>, f3 array<double>").withColumn("f4", F.lit(None))
    assert tuple(df.agg(profile.num_columns(df).alias("d")).select("d.*").first())[:4] == (2, 3, 4, 11)
    values = {r.kind: (r["count"], r["sum"]) for r in profile.value_distributions(df).collect()}
    assert values == {"INT": (4, 4), "FLOAT": (4, 2), "STRING": (4, 3), "NULL": (4, 4), "ALL": (16, 13)}
    assert {r.kind: r.cells for r in profile.num_cells(df).collect()} == {"NULL": 4, "STRING": 3, "INT": 4, "FLOAT": 4}
    p = {r.metric.rsplit("-", 1)[1]: tuple(r)[1:] for r in profile.profile(df).collect()}
    assert p["num_feature_values"] == (0, 2, 16, 13) and p["num_feature_values[INT]"] == (1, 1, 4, 4) and p["num_rows"] == (4, 4, 1, 4)
    assert profile.value_distributions(df, 0.0).count() == 0
    same, o = profile.observed(df)
    assert same.count() == 4 and o.get["num_rows"] == 4 and o.get["columns_sum"] == 11


def test_profile_nested(spark):
    df = spark.createDataFrame([([([1, 2], 5), None],), (None,), ([],)], "c array<struct<a:array<int>,b:int>>")
    n = {i: [r[0] for r in df.select(c).collect()] for i, (k, c) in enumerate(profile.num_values(df))}
    assert n == {0: [2, 0, 0], 1: [1, 0, 0]}


def test_names(spark):
    assert profile.metric_name("a", "b", "n") == "LogicalFormat[a]-PhysicalFormat[b]-n" and profile.namespace("x", "y") == "x.y"
    with pytest.raises(ValueError):
        profile.metric_name("a-b", "c", "n")
    df = spark.createDataFrame([(b"abc",), (b"",)], "r binary")
    assert tuple(profile.raw_records(df, "r").first()) == (2, 0, 3, 2, 3)
    t = profile.LoadTimer()
    assert t(lambda x: x + 1, 2) == 3 and t.distribution()[2] == 1
