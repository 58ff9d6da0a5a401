"""List kernels: the small vectors that pin their semantics."""

import pytest
from pyspark.sql import functions as F

from gneiss.functions import arrays as A

LISTS = [(0, [1, 2, 3]), (1, []), (2, None), (3, [4, 5])]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(LISTS, "row long, c array<int>")


def col(df, c):
    return [r[0] for r in df.orderBy("row").select(c).collect()]


def test_element_lengths(spark, lists):
    assert col(lists, A.element_lengths(lists, "c")) == [3, 0, 0, 2]
    t = spark.createDataFrame([(0, "aé", b"ab"), (1, None, None), (2, "", b"")], "row long, s string, b binary")
    assert col(t, A.element_lengths(t, "s")) == [3, 0, 0] and col(t, A.element_lengths(t, "b")) == [2, 0, 0]
    with pytest.raises(TypeError):
        A.element_lengths(lists, "row")


def test_parent_indices_and_bitmap(lists):
    assert sorted(tuple(r) for r in A.parent_indices(lists, "c", "row").collect()) == [(0, 0), (0, 1), (0, 2), (3, 0), (3, 1)]
    assert col(lists, A.null_bitmap("c")) == [0, 0, 1, 0]


@pytest.mark.parametrize("as_null,none", [(True, None), (False, [])])
def test_regroup(spark, as_null, none):
    flat = spark.createDataFrame([(0, 0, "a"), (0, 2, "c"), (0, 1, "b"), (3, 4, "e"), (3, 3, "d")], "parent long, pos int, value string")
    got = {r.parent: r["values"] for r in A.regroup_range(flat, 4, empty_as_null=as_null).collect()}
    assert got == {0: ["a", "b", "c"], 1: none, 2: none, 3: ["d", "e"]}
    assert [r["values"] for r in A.regroup_range(flat.limit(0), 5, empty_as_null=as_null).collect()] == [none] * 5
    with pytest.raises(Exception, match="is not in 0..0"):
        A.regroup_range(spark.createDataFrame([(1, 0, "a")], "parent long, pos int, value string"), 1).collect()
    with pytest.raises(TypeError):
        A.regroup_range(flat.withColumn("parent", F.col("parent").cast("int")), 4)


@pytest.mark.parametrize(
    "kind,values,coo,shape",
    [
        ("array<string>", [["a", "b"], ["c"], [], ["d", "e"]], [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (3, 0, "d"), (3, 1, "e")], [4, 2]),
        ("array<array<string>>", [[["a", "b"], ["c"]], [[], ["d", "e"]]], [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "c"), (1, 1, 0, "d"), (1, 1, 1, "e")], [2, 2, 2]),
        ("array<int>", [[]], [], [1, 0]),
        ("array<int>", [None, [1]], [(1, 0, 1)], [2, 1]),
        ("array<array<int>>", [[None, [7]], None], [(0, 1, 0, 7)], [2, 2, 1]),
    ],
)
def test_coo(spark, kind, values, coo, shape):
    df = spark.createDataFrame(list(enumerate(values)), f"row long, c {kind}")
    assert sorted(tuple(r) for r in A.coo(df, "c", "row").collect()) == coo
    assert A.coo_shape(df, "c").first()[0] == shape


def test_fill_and_singleton(spark, lists):
    assert col(lists, A.fill_null_lists(lists, "c", [])) == [[1, 2, 3], [], [], [4, 5]]
    assert col(lists, A.fill_null_lists(lists, "c", [9, 9])) == [[1, 2, 3], [], [9, 9], [4, 5]]
    t = spark.createDataFrame([(0, "x"), (1, None)], "row long, c string")
    assert col(t, A.singleton("c")) == [["x"], None]


def test_flatten_nested(spark):
    t = spark.createDataFrame([(0, [[[1, 2], None], [[3]]]), (1, None), (2, [None, [[]]])], "row long, c array<array<array<int>>>")
    assert sorted(tuple(r) for r in A.flatten_nested(t, "c", "row").collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 3)]
    assert sorted(tuple(r) for r in A.flatten_nested(t.select("row", F.lit(5).alias("c")), "c", "row").collect()) == [(0, 0, 5), (1, 0, 5), (2, 0, 5)]


@pytest.mark.parametrize(
    "values,among,want",
    [
        ([99, 42, 3, None], [3, 4, 99], [2, None, 0, None]),
        (["aa", "bb", "cc", None], ["cc", "cc", "aa"], [1, None, 0, None]),
        (["aa", "bb", "cc", None], ["cc", None, None, "bb"], [None, 2, 0, 1]),
        (["aa", None], [None, "aa"], [1, 0]),
    ],
)
def test_index_in(spark, values, among, want):
    kind = "int" if isinstance(values[0], int) else "string"
    df = spark.createDataFrame(list(enumerate(values)), f"row long, c {kind}")
    assert col(df, A.index_in("c", among)) == want
    distinct = list(dict.fromkeys(among))
    for small in (100, 0):  # broadcast, and beyond the size that is
        side = spark.createDataFrame([(v, i) for i, v in enumerate(distinct)], f"value {kind}, pos int")
        assert [r.index_in for r in A.index_in_table(df, "c", side, small=small).orderBy("row").collect()] == want


def test_byte_size(spark):
    t = spark.createDataFrame([([1, 2], "ab", None, (1, "x")), (None, "é", None, None), ([], None, None, (None, None))], "l array<int>, s string, n void, t struct<a:int,b:string>")
    size = lambda c: t.agg(A.byte_size(t, c)).first()[0]
    assert size("l") == 1 + 4 * 8 + 1 + 2 * 4
    assert size("s") == 1 + 4 * 8 + 4
    assert size("n") == 0
    assert size("t") == 1 + (1 + 12) + (1 + 4 * 8 + 1)
    d = spark.sql("select date'2020-01-01' as d, map('a', 1) as m")
    with pytest.raises(TypeError):
        A.total_byte_size(d)
    assert d.agg(A.total_byte_size(d, ignore_unsupported=True)).first()[0] == 4


def test_invalid_utf8(spark):
    values = [b"a", b"b", bytes.fromhex("fca1a1a1a1a1"), None, b"\xed\xa0\x80", b"\xc0\x80", "é".encode(), b"\xe2\x82"]
    df = spark.createDataFrame([(v,) for v in values], "b binary")
    assert df.agg(A.invalid_utf8("b")).first()[0] == 4
