"""Schema messages in wire form."""

import struct

import pytest

from gneiss.plans import schema_binary, schema_text
from gneiss.plans.features import Feature, FeatureSchema, Representation, SparseFeature

SCHEMA = FeatureSchema(
    (
        Feature("x", "INT", shape=(2, 3), min_fraction=1.0), Feature("y", "FLOAT", value_count=(1, 4)), Feature('odd "name"é', "BYTES"),
        Feature("s", "STRUCT", children=(Feature("c", "INT"),)), Feature("old", deprecated=True), Feature("p", stage="PLANNED"), Feature("i", "INT"), Feature("v", "FLOAT"),
    ),
    (SparseFeature("sp", ("i",), "v", sorted=True),),
    {"": {
        "t": Representation("dense", ("x",), (2, 3), default=-1), "u": Representation("varlen", ("y",)), "w": Representation("sparse", ("v",), indices=("i",), sizes=(-1,), sorted=False),
        "r": Representation("ragged", ("s", "c"), partitions=(("lengths", "l"), ("uniform", 2))), "b": Representation("dense", ("old",), (), default=b"\x00\"q"), "f": Representation("dense", ("y",), (), default=0.5),
    }},
)


def test_both_forms_are_one_schema(spark, tmp_path):
    data = schema_binary.format_schema(SCHEMA)
    assert schema_binary.parse_schema(data) == SCHEMA == schema_text.parse_schema(schema_text.format_schema(SCHEMA))
    (tmp_path / "schema.pb").write_bytes(data)
    assert schema_binary.read_schema(spark, str(tmp_path / "schema.pb")) == SCHEMA
    assert schema_binary.parse_schema(b"") == FeatureSchema()


def test_known_bytes():
    feature = b"\x0a\x01a" + b"\x30\x02" + b"\x2a\x04\x08\x01\x10\x01" + b"\x72\x09\x09" + struct.pack("<d", 1.0)
    unknown = b"\xa2\x06\x02hi" + b"\xa8\x06\x05" + b"\xb1\x06" + bytes(8) + b"\xbd\x06" + bytes(4)  # fields of numbers that no descriptor names
    data = b"\x0a" + bytes([len(feature) + len(unknown)]) + unknown + feature + unknown
    assert schema_binary.parse_schema(data) == FeatureSchema((Feature("a", "INT", value_count=(1, 1), min_fraction=1.0),))
    assert schema_binary.parse_schema(data + b"\x70\x01").features[0].ragged


def test_ragged_features():
    every = FeatureSchema((Feature("a", "INT", ragged=True), Feature("b", "FLOAT", ragged=True)))
    assert schema_binary.parse_schema(schema_binary.format_schema(every)) == every
    with pytest.raises(ValueError, match="represent_variable"):
        schema_binary.format_schema(FeatureSchema((Feature("a", "INT", ragged=True), Feature("b"))))


@pytest.mark.parametrize("bad", [b"\x0a", b"\x0a\x05a", b"\x0a\x02\x0a\x09", b"\x0b", b"\x08\x01", b"\x0a\x02\x0d\x00", b"\xff" * 12])
def test_damaged_messages(bad):
    with pytest.raises(ValueError):
        schema_binary.parse_schema(bad)


def test_another_descriptor():
    """A set of file descriptors for messages with other numbers, enumerations and packed values."""
    out = lambda message, m: schema_binary.format_binary(m, message, schema_binary._DESCRIPTORS, {})
    field = lambda name, number, kind, of=None: {"name": [name], "number": [number], "type": [kind], **({"type_name": [of]} if of else {})}
    file = {
        "package": ["my.own"],
        "message_type": [
            {"name": ["Schema"], "field": [field("feature", 3, 11, ".my.own.Schema.Feature"), field("generate_legacy_feature_spec", 9, 8)],
             "nested_type": [{"name": ["Feature"], "field": [field("name", 200, 9), field("type", 4, 14, ".my.own.Kind"), field("numbers", 5, 3), field("reals", 6, 2), field("turned", 7, 18)]}]},
        ],
        "enum_type": [{"name": ["Kind"], "value": [{"name": ["BYTES"], "number": [0]}, {"name": ["INT"], "number": [7]}]}],
    }
    messages, enums = schema_binary.descriptor_of(out("FileDescriptorSet", {"file": [file]}))
    assert enums == {"my.own.Kind": {0: "BYTES", 7: "INT"}} and messages["my.own.Schema"][3] == ("feature", "my.own.Schema.Feature")
    schema = FeatureSchema((Feature("a", "INT"), Feature("b")), legacy=True)
    data = schema_binary.format_schema(schema, "my.own.Schema", messages, enums)
    assert schema_binary.parse_schema(data, "my.own.Schema", messages, enums) == schema
    packed = b"\x2a\x03\x01\x96\x01" + b"\x32\x08" + struct.pack("<2f", 1.5, -2.0) + b"\x38\x03" + b"\x20\x07"
    assert schema_binary.parse_binary(packed, "my.own.Schema.Feature", messages, enums) == {"numbers": [1, 150], "reals": [1.5, -2.0], "turned": [-2], "type": ["INT"]}
