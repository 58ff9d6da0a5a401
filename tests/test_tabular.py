"""Sources as one interface: columns, tensors, projection."""

import pytest

from gneiss.plans.features import Feature, FeatureSchema, Representation, set_representations
from gneiss.sources import csv, examples, records, tabular, wire

SCHEMA = FeatureSchema((Feature("int_feature", "INT", shape=(1,), min_fraction=1), Feature("float_feature", "FLOAT", shape=(4,), min_fraction=1), Feature("string_feature", "BYTES"), Feature("varlen_feature", "INT"), Feature("row_lengths", "INT")))
RECORDS = [
    {"int_feature": ("INT", [1]), "float_feature": ("FLOAT", [1, 2, 3, 4]), "string_feature": (None, None), "varlen_feature": ("INT", [1, 2, 3]), "row_lengths": ("INT", [2, 1])},
    {"int_feature": ("INT", [2]), "float_feature": ("FLOAT", [2, 3, 4, 5]), "string_feature": ("BYTES", [b"foo", b"bar"]), "varlen_feature": ("INT", [4]), "row_lengths": ("INT", [1])},
    {"int_feature": ("INT", [3]), "float_feature": ("FLOAT", [4, 5, 6, 7]), "varlen_feature": ("INT", [5, 6]), "row_lengths": ("INT", [1, 1])},
]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("records") / "r")
    records.write_records(spark.createDataFrame([(wire.build_example(r),) for r in RECORDS], "record binary"), p)
    return f"{p}/part-*"


def test_examples(spark, path):
    src = tabular.Examples(path, SCHEMA, raw_record="raw")
    df = src.load(spark)
    assert df.columns == [*[f.name for f in SCHEMA.features], "raw"] and df.schema.simpleString() == src.spark_schema().simpleString()
    rows = {r.int_feature[0]: r for r in df.collect()}
    assert rows[1].string_feature is None and rows[3].string_feature is None and rows[2].string_feature == [b"foo", b"bar"]
    assert wire.parse_example(bytes(rows[3].raw[0])) == RECORDS[2]
    t = {r.int_feature[0]: r for r in src.tensors(spark).collect()}
    assert t[1].float_feature == [1, 2, 3, 4] and t[2].string_feature["values"] == [b"foo", b"bar"] and t[1].string_feature.indices == []
    # the order of the schema does not matter
    other = tabular.Examples(path, FeatureSchema(SCHEMA.features[::-1])).load(spark)
    assert sorted(map(repr, other.select(df.columns[:-1]).collect())) == sorted(map(repr, df.drop("raw").collect()))


def test_projection(spark, path):
    src = tabular.Examples(path, SCHEMA)
    part = src.project(["string_feature", "int_feature"])
    assert part.load(spark).columns == ["int_feature", "string_feature"]
    again = part.project(["float_feature"])
    assert again.load(spark).columns == ["float_feature"]
    a = again.adapter(again.load(spark))
    assert set(a.type_specs()) == {"float_feature"} and set(a.original_type_specs()) == set(src.representations())
    with pytest.raises(ValueError):
        src.project(["no"])
    with pytest.raises(ValueError):
        tabular.Examples(path).representations()
    assert tabular.Examples(path).load(spark).columns == sorted(f.name for f in SCHEMA.features)
    with pytest.raises(ValueError):
        tabular.Examples(path, SCHEMA, raw_record="int_feature")


def test_ragged_representation(spark, path):
    s = set_representations(SCHEMA, {"rag": Representation("ragged", ("varlen_feature",), partitions=(("lengths", "row_lengths"),))})
    src = tabular.Examples(path, s).project(["rag"])
    assert set(src.load(spark).columns) == {"varlen_feature", "row_lengths"}
    assert sorted(r.rag for r in src.tensors(spark).collect()) == [[[1, 2], [3]], [[4]], [[5], [6]]]


def test_local_batches(spark, path):
    src = tabular.Examples(path, SCHEMA)
    assert [len(b) for b in src.batches(spark, 2)] == [2, 1]
    features, label = next(src.labelled(spark, 3, "int_feature"))[0]
    assert "int_feature" not in features and label in ([1], [2], [3])


def test_others(spark, path, tmp_path):
    lines = lambda s: s.createDataFrame([('1,2.0,"abc"',), ('2,3.0,"xyz"',)], "value string")
    schema = FeatureSchema((Feature("i", "INT"), Feature("f", "FLOAT"), Feature("s", "BYTES")))
    c = tabular.Csv(lines, csv.CsvFormat(("i", "f", "s")), schema)
    assert [tuple(r) for r in c.load(spark).collect()] == [([1], [2.0], [b"abc"]), ([2], [3.0], [b"xyz"])]
    p = c.project(["f"])
    assert p.load(spark).columns == ["i", "f", "s"] and p.tensors(spark).columns == ["f"]
    c.load(spark).write.parquet(str(tmp_path / "p"))
    q = tabular.Parquet(str(tmp_path / "p"), schema).project(["i", "f"])
    assert q.load(spark).columns == ["i", "f"] and q.load(spark).count() == 2
    raw = tabular.RawRecords(path)
    assert raw.load(spark).count() == 3 and raw.project(["raw_record"]).tensors(spark).columns == ["raw_record"]
    custom = tabular.Custom(lines, lambda df: df.selectExpr("array(value) as s"), FeatureSchema((Feature("s", "BYTES"),)))
    assert custom.load(spark).count() == 2


def test_sequences(spark):
    rec = wire.build_sequence({"c": ("INT", [1])}, {"x": [("INT", [1, 2]), ("INT", [3])], "y": [("BYTES", [b"q"])]})
    schema = FeatureSchema((Feature("c", "INT"), Feature(examples.SEQUENCE, "STRUCT", children=(Feature("x", "INT"), Feature("y", "BYTES")))))
    src = tabular.Sequences(lambda s: s.createDataFrame([(rec,)], "record binary"), schema)
    assert set(src.representations()) == {"c", "##SEQUENCE##.x", "##SEQUENCE##.y"}
    part = src.project(["##SEQUENCE##.x"])
    df = part.load(spark)
    assert df.schema[examples.SEQUENCE].dataType.fieldNames() == ["x"]
    assert part.tensors(spark).first()[0] == [[1, 2], [3]]
