"""Schema messages in the protocol buffer wire form, read into a FeatureSchema and written from one.

The reader is driven by a descriptor: message names, and by field number a field's name and type. MESSAGES holds what the engine
reads of schema messages; descriptor_of() takes another one from a serialised set of file descriptors, so schemas of any version can be
read. Fields that a descriptor doesn't name are read over. Both forms give the same message (see schema_text.parse_text).
"""

from __future__ import annotations

import struct

from gneiss.plans import schema_text
from gneiss.plans.features import FeatureSchema
from gneiss.sources.wire import _delimited, _fields, _out_varint, _varint

#: Fields of the public schema messages that are read, by number.
_FIELDS = """
Schema 1 feature Feature
Schema 6 sparse_feature SparseFeature
Schema 13 tensor_representation_group TensorRepresentationGroupEntry
Schema 14 represent_variable_length_as_ragged bool
Feature 1 name string
Feature 2 deprecated bool
Feature 5 value_count ValueCount
Feature 6 type FeatureType
Feature 14 presence FeaturePresence
Feature 22 lifecycle_stage LifecycleStage
Feature 23 shape FixedShape
Feature 29 struct_domain StructDomain
ValueCount 1 min int64
ValueCount 2 max int64
FeaturePresence 1 min_fraction double
FeaturePresence 2 min_count int64
FixedShape 2 dim Dim
Dim 1 size int64
Dim 2 name string
StructDomain 1 feature Feature
SparseFeature 1 name string
SparseFeature 5 dense_shape FixedShape
SparseFeature 6 index_feature IndexFeature
SparseFeature 8 is_sorted bool
SparseFeature 9 value_feature ValueFeature
IndexFeature 1 name string
ValueFeature 1 name string
TensorRepresentationGroupEntry 1 key string
TensorRepresentationGroupEntry 2 value TensorRepresentationGroup
TensorRepresentationGroup 1 tensor_representation TensorRepresentationEntry
TensorRepresentationEntry 1 key string
TensorRepresentationEntry 2 value TensorRepresentation
TensorRepresentation 1 dense_tensor DenseTensor
TensorRepresentation 2 varlen_sparse_tensor VarLenSparseTensor
TensorRepresentation 3 sparse_tensor SparseTensor
TensorRepresentation 4 ragged_tensor RaggedTensor
DenseTensor 1 column_name string
DenseTensor 2 shape FixedShape
DenseTensor 3 default_value DefaultValue
DefaultValue 1 float_value double
DefaultValue 2 int_value int64
DefaultValue 3 bytes_value bytes
VarLenSparseTensor 1 column_name string
SparseTensor 1 dense_shape FixedShape
SparseTensor 2 index_column_names string
SparseTensor 3 value_column_name string
SparseTensor 4 already_sorted bool
RaggedTensor 1 feature_path Path
RaggedTensor 3 partition Partition
Partition 1 uniform_row_length int64
Partition 2 row_length string
Path 1 step string
"""
#: Enumerations of the same messages, by number.
ENUMS = {
    "FeatureType": {0: "TYPE_UNKNOWN", 1: "BYTES", 2: "INT", 3: "FLOAT", 4: "STRUCT"},
    "LifecycleStage": {0: "UNKNOWN_STAGE", 1: "PLANNED", 2: "ALPHA", 3: "BETA", 4: "PRODUCTION", 5: "DEPRECATED", 6: "DEBUG_ONLY", 7: "DISABLED", 8: "VALIDATION_DERIVED"},
}
#: Scalar types by their number in a field descriptor.
_SCALARS = {1: "double", 2: "float", 3: "int64", 4: "uint64", 5: "int64", 8: "bool", 9: "string", 12: "bytes", 13: "uint64", 17: "sint64", 18: "sint64"}

RAGGED = "represent_variable_length_as_ragged"
Descriptor = dict[str, dict[int, tuple[str, str]]]


def _table(text: str) -> Descriptor:
    out: Descriptor = {}
    for message, number, name, kind in map(str.split, text.strip().splitlines()):
        out.setdefault(message, {})[int(number)] = (name, kind)
    return out


MESSAGES = _table(_FIELDS)


def _scalar(kind: str, wire: int, v):
    if kind in ("double", "float"):
        size, code = (8, "<d") if kind == "double" else (4, "<f")
        if not isinstance(v, bytes) or len(v) != size:
            raise ValueError(f"{kind} in another wire type")
        return struct.unpack(code, v)[0]
    if kind in ("string", "bytes"):
        if wire != 2:
            raise ValueError(f"{kind} in another wire type")
        return bytes(v)
    if wire:
        raise ValueError(f"{kind} in another wire type")
    if kind == "bool":
        return bool(v)
    if kind == "sint64":
        return v >> 1 ^ -(v & 1)
    return v - (1 << 64) if kind == "int64" and v >= 1 << 63 else v


def parse_binary(data: bytes, message: str = "Schema", messages: Descriptor | None = None, enums: dict | None = None) -> dict[str, list]:
    """A message as {field: values}, as parse_text() gives it."""
    messages, enums = messages or MESSAGES, enums or ENUMS
    out: dict[str, list] = {}
    fields = messages[message]
    for number, wire, v in _fields(data):
        if number not in fields:
            continue
        name, kind = fields[number]
        values = out.setdefault(name, [])
        if kind in messages:
            if wire != 2:
                raise ValueError(f"{name} is a message")
            values.append(parse_binary(v, kind, messages, enums))
        elif wire == 2 and kind not in ("string", "bytes"):  # repeated numbers, packed
            width = {"double": 8, "float": 4}.get(kind)
            if width:
                values += [_scalar(kind, 1, v[i : i + width]) for i in range(0, len(v), width)]
            else:
                at = 0
                while at < len(v):
                    x, at = _varint(v, at)
                    values.append(enums[kind].get(x, x) if kind in enums else _scalar(kind, 0, x))
        elif kind in enums:
            values.append(enums[kind].get(v, v))
        else:
            values.append(_scalar(kind, wire, v))
    return out


def format_binary(m: dict[str, list], message: str = "Schema", messages: Descriptor | None = None, enums: dict | None = None) -> bytes:
    """The wire form of a message as parse_text() gives it; fields in the order of their numbers."""
    messages, enums = messages or MESSAGES, enums or ENUMS
    known = {name: (number, kind) for number, (name, kind) in messages[message].items()}
    missing = [name for name in m if name not in known]
    if missing:
        raise ValueError(f"{message} has no field {missing[0]} in this descriptor")
    out = []
    for name in sorted(m, key=lambda x: known[x][0]):
        number, kind = known[name]
        for v in m[name]:
            if kind in messages:
                out.append(_delimited(number, format_binary(v, kind, messages, enums)))
            elif kind in ("string", "bytes"):
                out.append(_delimited(number, v.encode() if isinstance(v, str) else v))
            elif kind in ("double", "float"):
                out.append(_out_varint(number << 3 | (1 if kind == "double" else 5)) + struct.pack("<d" if kind == "double" else "<f", v))
            else:
                if kind in enums and isinstance(v, str):
                    v = next(k for k, x in enums[kind].items() if x == v)
                v = int(v)
                out.append(_out_varint(number << 3) + _out_varint(v << 1 ^ v >> 63 if kind == "sint64" else v))
    return b"".join(out)


#: The fields of descriptor messages that are read.
_DESCRIPTORS = _table(
    """
FileDescriptorSet 1 file FileDescriptorProto
FileDescriptorProto 2 package string
FileDescriptorProto 4 message_type DescriptorProto
FileDescriptorProto 5 enum_type EnumDescriptorProto
DescriptorProto 1 name string
DescriptorProto 2 field FieldDescriptorProto
DescriptorProto 3 nested_type DescriptorProto
DescriptorProto 4 enum_type EnumDescriptorProto
FieldDescriptorProto 1 name string
FieldDescriptorProto 3 number int64
FieldDescriptorProto 5 type int64
FieldDescriptorProto 6 type_name string
EnumDescriptorProto 1 name string
EnumDescriptorProto 2 value EnumValueDescriptorProto
EnumValueDescriptorProto 1 name string
EnumValueDescriptorProto 2 number int64
"""
)


def descriptor_of(data: bytes) -> tuple[Descriptor, dict]:
    """Messages and enumerations of a serialised set of file descriptors, under their full names (package first, dots between)."""
    messages: Descriptor = {}
    enums: dict[str, dict[int, str]] = {}
    text = lambda m, name: m.get(name, [b""])[-1].decode()

    def enum(prefix, e):
        enums[f"{prefix}{text(e, 'name')}"] = {v.get("number", [0])[-1]: text(v, "name") for v in e.get("value", ())}

    def walk(prefix, m):
        name = f"{prefix}{text(m, 'name')}"
        messages[name] = {}
        for f in m.get("field", ()):
            kind = _SCALARS.get(f["type"][-1]) or text(f, "type_name").lstrip(".")
            messages[name][f["number"][-1]] = (text(f, "name"), kind)
        for x in m.get("nested_type", ()):
            walk(f"{name}.", x)
        for x in m.get("enum_type", ()):
            enum(f"{name}.", x)

    for file in parse_binary(data, "FileDescriptorSet", _DESCRIPTORS, {}).get("file", ()):
        package = text(file, "package")
        prefix = f"{package}." if package else ""
        for m in file.get("message_type", ()):
            walk(prefix, m)
        for e in file.get("enum_type", ()):
            enum(prefix, e)
    return messages, enums


def parse_schema(data: bytes, message: str = "Schema", messages: Descriptor | None = None, enums: dict | None = None) -> FeatureSchema:
    """A serialised schema message."""
    return schema_text.schema_of(parse_binary(data, message, messages, enums))


def format_schema(schema: FeatureSchema, message: str = "Schema", messages: Descriptor | None = None, enums: dict | None = None) -> bytes:
    """A schema in wire form; parse_schema() reads it back."""
    m = schema_text.parse_text(schema_text.format_schema(schema))
    features = m.get("feature", [])
    if features and all(RAGGED in f for f in features):  # said once for all features
        m["feature"], m[RAGGED] = [{k: v for k, v in f.items() if k != RAGGED} for f in features], [True]
    return format_binary(m, message, messages, enums)


def read_schema(spark, path: str) -> FeatureSchema:
    """A schema file in wire form, from any store that Spark knows."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()  # one file
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return parse_schema(bytes(rows[0][0]))
