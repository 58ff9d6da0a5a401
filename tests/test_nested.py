"""Paths, walks, canonical forms, unions, gathering, batches."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators import paths, relational
from gneiss.operators.paths import ColumnPath


def test_column_path():
    p = ColumnPath(["a", "b", "c"])
    assert p.parent() == ColumnPath(("a", "b")) and p.child("d").steps() == ("a", "b", "c", "d")
    assert p.prefix(1) == ColumnPath("a") and p.suffix(2) == ColumnPath("c") and p.initial_step() == "a"
    assert ColumnPath.from_dict(p.to_dict()) == p and str(p) == "a.b.c" and len(p) == 3 and not ColumnPath()
    assert ColumnPath("a") < ColumnPath(("a", "b")) < ColumnPath("b") and len({p, ColumnPath(("a", "b", "c"))}) == 1
    for f in (ColumnPath().parent, ColumnPath().initial_step):
        with pytest.raises(ValueError):
            f()


@pytest.fixture(scope="module")
def nested(spark):
    schema = (
        "row long, f1 array<bigint>, f2 array<struct<sf1:array<string>,sf2:array<struct<ssf1:array<bigint>>>>>, "
        "f3 struct<sf1:array<array<bigint>>,sf2:array<void>>"
    )
    return spark.createDataFrame(
        [(0, [1], [(["a", "b"], None)], ([[1, 2], [3]], [None])), (1, [2, 3], [(None, [([3],), ([4],)])], None)], schema
    )


@pytest.mark.parametrize(
    "path,want",
    [
        ("f1", [(0, [1]), (1, [2, 3])]),
        (("f2", "sf1"), [(0, ["a", "b"]), (1, None)]),
        (("f2", "sf2", "ssf1"), [(1, [3]), (1, [4])]),
        (("f3", "sf1"), [(0, [[1, 2], [3]]), (1, None)]),
        (("f3", "sf2"), [(0, [None]), (1, None)]),
    ],
)
def test_get_array(nested, path, want):
    got = paths.get_array(nested, path, "row").orderBy("row", "order").collect()
    assert [(r.row, r.value) for r in got] == want


def test_paths_of(nested):
    every = [str(p) for p, _ in paths.enumerate_paths(nested.drop("row").schema)]
    assert every == ["f1", "f2", "f2.sf1", "f2.sf2", "f2.sf2.ssf1", "f3", "f3.sf1", "f3.sf2"]
    assert [str(p) for p, _ in paths.enumerate_arrays(nested, "row", leaves_only=True)] == ["f1", "f2.sf1", "f2.sf2.ssf1", "f3.sf1", "f3.sf2"]
    for bad in ((), "x", ("f2", "x"), ("f1", "x")):
        with pytest.raises(KeyError):
            paths.get_array(nested, bad, "row")
    with pytest.raises(KeyError):
        paths.get_field(nested, "f3", "x")
    assert [r[0] for r in nested.orderBy("row").select(paths.get_field(nested, "f3", "sf1")).collect()] == [[[1, 2], [3]], None]


def test_missing_structs(spark):
    df = spark.createDataFrame([(0, []), (1, [([2.0],), None]), (2, [None]), (3, [])], "row long, c array<struct<f2:array<double>>>")
    got = paths.get_array(df, ("c", "f2"), "row").orderBy("row", "order").collect()
    assert [(r.row, r.value) for r in got] == [(1, [2.0]), (1, None), (2, None)]


def test_canonicalize(spark):
    rows = [(17, "english", False, False, ["ne"]), (30, "spanish", True, True, ["s", "ted"])]
    df = spark.createDataFrame(rows, "age int, language string, prediction boolean, label boolean, nested array<string>")
    out = relational.canonicalize(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["array<bigint>", "array<binary>", "array<tinyint>", "array<tinyint>", "array<binary>"]
    assert tuple(out.collect()[1]) == ([30], [b"spanish"], [1], [1], [b"s", b"ted"])
    assert relational.kind_to_type("f") == "double" and relational.kind_to_type("M") is None
    with pytest.raises(TypeError):
        relational.canonicalize(spark.sql("select date'2020-01-01' as d"))
    assert relational.canonicalize(spark.createDataFrame([(None,)], "a int")).first()[0] is None


def test_merge(spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = relational.merge_batches([d([(None,)] * 2, "s void"), d([(None,)] * 2, "t void"), d([((1, None),), ((None, [2]),), (None,)], "s struct<f1:int,f2:array<int>>"), d([("fox",), (None,)], "t string")])
    assert out.columns == ["s", "t"] and out.count() == 9
    assert [r.s for r in out.collect()][4:7] == [Row(f1=1, f2=None), Row(f1=None, f2=[2]), None]
    assert [r.t for r in out.collect()] == [None] * 7 + ["fox", None]
    out = relational.merge_batches([d([([None, None],), (None,)], "f array<void>"), d([([[123]],), (None,)], "f array<array<int>>")])
    assert out.schema["f"].dataType.simpleString() == "array<array<int>>" and out.collect() == [Row(f=[None, None]), Row(f=None), Row(f=[[123]]), Row(f=None)]
    out = relational.merge_batches([d([((1,),)], "s struct<a:int>"), d([(("x",),)], "s struct<b:string>")])
    assert out.collect() == [Row(s=Row(a=1, b=None)), Row(s=Row(a=None, b="x"))]
    for a, b in (("a int", "a string"), ("a int", "a bigint"), ("a array<int>", "a array<float>"), ("a struct<x:int>", "a struct<x:string>"), ("a int", "a array<int>")):
        with pytest.raises(TypeError, match="don't merge"):
            relational.merge_batches([d([], a), d([], b)])
    with pytest.raises(ValueError):
        relational.merge_batches([])


def test_take(spark):
    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(5)], "i long, v string")
    assert [r.v for r in relational.take_list(df, "i", [4, 0, 0, 2]).orderBy("pos").collect()] == ["e", "a", "a", "c"]


def test_batches(spark):
    df = spark.range(0, 200_000, 3).withColumnRenamed("id", "i")
    got = relational.batch_ids(df, "i", 1000).orderBy("i").collect()
    assert [r.batch_id for r in got] == [k // 1000 for k in range(len(got))]
    small = spark.range(10)
    sizes = lambda **o: [len(b) for b in relational.record_batches(small, **o)]
    assert sizes(batch_size=4) == [4, 4, 2] and sizes(batch_size=4, drop_final=True) == [4, 4] and sizes(batch_size=5, epochs=2) == [5] * 4
    forever = relational.record_batches(small, 4, epochs=None)
    assert [len(next(forever)) for _ in range(5)] == [4] * 5
    once = [r.id for b in relational.record_batches(small, 3, shuffle=True, seed=1) for r in b]
    assert sorted(once) == list(range(10)) and once == [r.id for b in relational.record_batches(small, 3, shuffle=True, seed=1) for r in b]
    pairs = next(relational.labelled_batches(spark.createDataFrame([(1, 2)], "x int, y int"), "y", batch_size=1))
    assert pairs == [(Row(x=1), 2)]
    with pytest.raises(KeyError):
        next(relational.labelled_batches(small, "no", batch_size=1))
    assert relational.batch_settings(7)["spark.sql.execution.arrow.maxRecordsPerBatch"] == "7"
    assert spark.range(1).select(relational.batch_weight(F.lit(10)), relational.batch_weight(F.lit(5000))).first()[:] == (2560, 5000)
    with pytest.raises(ValueError):
        relational.batch_settings(0)


def test_types_merge_nullable():
    assert relational.merged_type(T.NullType(), T.IntegerType()) == T.IntegerType()
