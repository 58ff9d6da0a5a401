"""Feature schemas, tensor representations and conversions."""

import pytest

from gneiss.operators import tensors as X
from gneiss.plans import features as P
from gneiss.plans.features import Feature, FeatureSchema, Representation, SparseFeature


def test_inference():
    s = FeatureSchema(
        (
            Feature("idx", "INT"), Feature("val", "FLOAT"), Feature("d", "INT", shape=(2, 3), min_fraction=1), Feature("v"), Feature("r", ragged=True),
            Feature("old", deprecated=True), Feature("alpha", stage="ALPHA"), Feature("st", "STRUCT", children=(Feature("a", "INT"), Feature("b", deprecated=True))),
        ),
        (SparseFeature("sp", ("idx",), "val", (10,)),),
    )
    got = P.infer_representations(s)
    assert {n: r.kind for n, r in got.items()} == {"sp": "sparse", "d": "dense", "v": "varlen", "r": "ragged", "st.a": "ragged"}
    assert got["sp"].sizes == (10,) and got["d"].shape == (2, 3)
    with pytest.raises(ValueError):
        P.infer_representations(FeatureSchema((Feature("d", shape=(1,), min_fraction=0.5),)))
    with pytest.raises(ValueError):
        P.infer_representations(FeatureSchema((Feature("val", "FLOAT"),), (SparseFeature("sp", ("no",), "val"),)))
    with pytest.raises(ValueError):
        P.infer_representations(FeatureSchema((Feature("i", "FLOAT"), Feature("val", "FLOAT")), (SparseFeature("sp", ("i",), "val"),)))


def test_legacy_inference():
    s = FeatureSchema((Feature("one", "INT", value_count=(1, 1), min_fraction=1), Feature("two", "FLOAT", value_count=(2, 2)), Feature("some", "BYTES", value_count=(0, 2)), Feature("b", value_count=(1, 1))))
    got = P.infer_legacy(s)
    assert (got["one"].shape, got["one"].default) == ((), None) and (got["two"].shape, got["two"].default) == ((2,), -1.0)
    assert got["some"].kind == "varlen" and got["b"].default == b""
    with pytest.raises(ValueError):
        P.infer_legacy(FeatureSchema((Feature("x", value_count=(-1, 1)),)))


def test_groups_and_projection():
    s = FeatureSchema((Feature("a", "INT"), Feature("b", "INT"), Feature("n", "INT"), Feature("st", "STRUCT", children=(Feature("v", "INT"), Feature("l", "INT")))))
    explicit = {"rag": Representation("ragged", ("b",), partitions=(("lengths", "n"),)), "deep": Representation("ragged", ("st", "v"), partitions=(("lengths", "l"),))}
    s = P.set_representations(s, explicit)
    assert P.get_representations(s) == explicit and P.get_representations(s, "other") is None
    assert P.source_columns(explicit["rag"]) == [("b",), ("n",)] and P.source_columns(explicit["deep"]) == [("st", "v"), ("st", "l")]
    assert P.source_value_column(explicit["deep"]) == ("st", "v")
    assert set(P.infer_mixed(s)) == {"rag", "deep", "a"}
    small = P.project(s, ["rag"])
    assert [f.name for f in small.features] == ["b", "n"]
    with pytest.raises(ValueError):
        P.project(s, ["no"])
    with pytest.raises(ValueError, match="in no representation"):
        P.validate_representations(s)
    P.validate_representations(P.set_representations(s, {**explicit, "a": Representation("varlen", ("a",))}))
    with pytest.raises(ValueError, match="not in the schema"):
        P.validate_representations(P.set_representations(s, {**explicit, "z": Representation("varlen", ("z",))}))


def test_parse_specs():
    assert P.parse_spec(Representation("dense", ("x",), shape=(2, 2), default=7), "INT") == P.ParseSpec("fixed", "INT", ("x",), (2, 2), (7,) * 4)
    for bad, kind in ((1.5, "INT"), (2**70, "INT"), ("x", "BYTES"), (True, "INT")):
        with pytest.raises(ValueError):
            P.parse_spec(Representation("dense", ("x",), default=bad), kind)
    with pytest.raises(ValueError):
        P.parse_spec(Representation("ragged", ("a", "b")), "INT")
    s = FeatureSchema((Feature("i", "INT"), Feature("v", "FLOAT"), Feature("w", "INT")), (SparseFeature("sp", ("i",), "v"),))
    assert {k: v.kind for k, v in P.parse_config(s).items()} == {"_parse_sp": "sparse", "w": "varlen"}
    with pytest.raises(ValueError, match="more than one"):
        P.parse_config(s, {"a": Representation("varlen", ("w",)), "b": Representation("varlen", ("w",))})
    q = FeatureSchema((Feature("c", "INT"), Feature("##SEQUENCE##", "STRUCT", children=(Feature("s", "BYTES"),))))
    context, steps = P.sequence_parse_specs(q)
    assert context["c"].kind == "varlen" and steps["s"].kind == "ragged"
    assert q.spark_type().simpleString() == "struct<c:array<bigint>,##SEQUENCE##:struct<s:array<array<binary>>>>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(0, [1, 2], [1.0, 2.0], [2, 1], [10, 20, 30], [0, 5]), (1, None, [], [], [], []), (2, [3, 4], [5.0], [1], [7], [9])],
        "row int, d array<bigint>, v array<double>, n array<bigint>, r array<bigint>, i array<bigint>",
    )


def col(df, c):
    return [r[0] for r in df.orderBy("row").select(c).collect()]


def test_conversions(rows):
    assert col(rows, X.dense(rows, Representation("dense", ("d",), shape=(2,), default=-1))) == [[1, 2], [-1, -1], [3, 4]]
    with pytest.raises(Exception, match="has not 2 values"):
        col(rows, X.dense(rows, Representation("dense", ("d",), shape=(2,))))
    got = col(rows, X.varlen(rows, Representation("varlen", ("v",))))
    assert [(r.indices, r["values"]) for r in got] == [([0, 1], [1.0, 2.0]), ([], []), ([0], [5.0])]
    t = rows.where("row <> 2").select("row", X.to_tensor(rows, "t", Representation("sparse", ("v",), indices=("i",), sizes=(-1,))))
    assert sorted(tuple(r) for r in X.sparse_rows(t, "t", "row", 1).collect()) == [(0, 0, 1.0), (0, 5, 2.0)]
    assert X.sparse_shape(t, "t").first()[0] == [2, 2]
    with pytest.raises(Exception, match="differ in number"):
        col(rows, X.sparse(rows, Representation("sparse", ("v",), indices=("r",), sizes=(-1,))))
    with pytest.raises(TypeError, match="tensor t"):
        X.to_tensor(rows, "t", Representation("sparse", ("v",), indices=("v",)))


def test_ragged(rows):
    by = Representation("ragged", ("r",), partitions=(("lengths", "n"),))
    assert col(rows, X.ragged(rows, by)) == [[[10, 20], [30]], [], [[7]]]
    assert col(rows.where("row = 0"), X.ragged(rows, Representation("ragged", ("r",), partitions=(("uniform", 3),)))) == [[[10, 20, 30]]]
    with pytest.raises(Exception, match="no multiple of 2"):
        col(rows, X.ragged(rows, Representation("ragged", ("r",), partitions=(("uniform", 2),))))
    with pytest.raises(Exception, match="add up"):
        col(rows, X.ragged(rows, Representation("ragged", ("v",), partitions=(("lengths", "n"),))))
    assert [tuple(r) for r in X.row_splits(rows, "r", "row").orderBy("order").collect()] == [(0, 3), (1, 3), (2, 4)]


def test_adapter(rows):
    reps = {"x": Representation("dense", ("d",), shape=(2,), default=0), "y": Representation("ragged", ("v",))}
    a = X.TensorAdapter(rows.schema, reps)
    assert a.type_specs() == {"x": ("dense", (-1, 2)), "y": ("ragged", (-1, -1))}
    assert a.to_tensors(rows, ["row"]).columns == ["row", "x", "y"]
    part = X.TensorAdapter(rows.schema, {"x": reps["x"]}, reps)
    assert set(part.type_specs()) == {"x"} and part.original_type_specs() == a.type_specs()
    with pytest.raises(ValueError):
        X.TensorAdapter(rows.schema, reps, {"x": reps["x"]})
    with pytest.raises(ValueError):
        a.to_tensors(rows.drop("d"))


def test_back(spark, rows):
    coo = spark.createDataFrame([(0, 1, 5), (0, 0, 4), (2, 0, 6)], "row long, i0 long, value long")
    got = X.from_sparse(coo, spark.range(3).withColumnRenamed("id", "row"), name="v").orderBy("row").collect()
    assert [r.v for r in got] == [[4, 5], [], [6]]
    nd = spark.createDataFrame([(0, 1, 1, 5), (0, 0, 2, 4)], "row long, i0 long, i1 long, value long")
    got = X.from_sparse_nd(nd, spark.range(2).withColumnRenamed("id", "row"), "t", 2).orderBy("row").collect()
    assert [tuple(r)[1:] for r in got] == [([4, 5], [0, 1], [2, 1]), ([], [], [])]
    df = rows.select("row", X.to_tensor(rows, "z", Representation("varlen", ("v",))), X.to_tensor(rows, "a", Representation("ragged", ("v",))))
    assert X.records_to_columns(df, ["z", "a"]).columns == ["a", "z"]
    with pytest.raises(TypeError):
        X.records_to_columns(spark.sql("select array(true) as b"), ["b"])
    with pytest.raises(ValueError):
        X.records_to_columns(df, ["a", "a"])
