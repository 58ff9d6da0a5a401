"""Schema messages in text form: what is read, what is written, what is an error."""

import pytest

from gneiss.plans.features import Feature, FeatureSchema, Representation, SparseFeature, infer_representations
from gneiss.plans.schema_text import format_schema, parse_schema, parse_text, read_schema

TEXT = """
feature: <name: 'a' type: INT, value_count: {min: 1, max: 0x}>
"""


def test_text_form():
    m = parse_text("a: 1 a: -2 b { c: 'x\\ty' 'z' d: [1.5, 2e3, inf] } # said\n e: TRUE_NAME; [ext.x] { y: true } f < g: -inf >")
    assert m["a"] == [1, -2] and m["b"][0]["c"] == [b"x\tyz"] and m["b"][0]["d"] == [1.5, 2000.0, float("inf")]
    assert m["e"] == ["TRUE_NAME"] and m["ext.x"] == [{"y": [True]}] and m["f"][0]["g"] == [float("-inf")]
    for bad in ("a {", "a: ", "{", "a: }", "?"):
        with pytest.raises((ValueError, IndexError)):
            parse_text(bad)


def test_round_trip(spark, tmp_path):
    schema = FeatureSchema(
        (
            Feature("x", "INT", shape=(2, 3), min_fraction=1.0), Feature("y", "FLOAT", value_count=(1, 4)), Feature('odd "name"\u00e9', "BYTES", ragged=True),
            Feature("s", "STRUCT", children=(Feature("c", "INT"),)), Feature("old", deprecated=True), Feature("p", stage="PLANNED"), Feature("i", "INT"), Feature("v", "FLOAT"),
        ),
        (SparseFeature("sp", ("i",), "v", sorted=True),),
        {"": {
            "t": Representation("dense", ("x",), (2, 3), default=-1), "u": Representation("varlen", ("y",)), "w": Representation("sparse", ("v",), indices=("i",), sizes=(-1,), sorted=False),
            "r": Representation("ragged", ("s", "c"), partitions=(("lengths", "l"), ("uniform", 2))), "b": Representation("dense", ("old",), (), default=b"\x00\"q"),
        }},
    )
    assert parse_schema(format_schema(schema)) == schema
    (tmp_path / "schema.pbtxt").write_text(format_schema(schema))
    assert read_schema(spark, str(tmp_path / "schema.pbtxt")) == schema


def test_legacy_switch():
    text = 'feature { name: "a" type: INT value_count { min: 1 max: 1 } } feature { name: "d" type: INT deprecated: true }'
    assert infer_representations(parse_schema(text))["a"].kind == "varlen"
    legacy = infer_representations(parse_schema("generate_legacy_feature_spec: true " + text))
    assert (legacy["a"].kind, legacy["a"].default) == ("dense", -1) and "d" not in legacy
