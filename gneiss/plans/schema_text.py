"""Schema messages in the protocol buffer text form, read into a FeatureSchema and written from one.

Fields that the engine makes no use of (domains, annotations, environments, ..) are read over.
"""

from __future__ import annotations

import re
from dataclasses import replace

from gneiss.plans.features import Feature, FeatureSchema, Representation, SparseFeature

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<name>[A-Za-z_][\w.]*)|(?P<number>-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?f?)|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<sign>[{}<>\[\]:;,-])""")

#: Escapes of the text form.
_ESCAPES = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, "'": 39, '"': 34, "?": 63}


def _bytes(quoted: str) -> bytes:
    def one(m):
        x = m[1]
        if x[0] in "xX":
            return bytes([int(x[1:], 16)])
        return bytes([int(x, 8) & 255]) if x[0].isdigit() else bytes([_ESCAPES[x]])

    out, at = b"", 0
    body = quoted[1:-1]
    for m in re.finditer(r"\\([xX][0-9a-fA-F]{1,2}|[0-7]{1,3}|.)", body):
        out += body[at : m.start()].encode() + one(m)
        at = m.end()
    return out + body[at:].encode()


def parse_text(text: str) -> dict[str, list]:
    """A message as {field: values}; a value is a message, bytes, a number, or a name as str."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not in text form: {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    place = 0

    def value():
        nonlocal place
        kind, x = tokens[place]
        if x in ("{", "<"):
            place += 1
            return message("}" if x == "{" else ">")
        place += 1
        if kind == "number":
            return float(x.rstrip("f")) if re.search(r"[.eEf]", x) else int(x)
        if kind == "text":
            out = _bytes(x)
            while place < len(tokens) and tokens[place][0] == "text":
                out += _bytes(tokens[place][1])
                place += 1
            return out
        if x == "-":
            return -value() if tokens[place][0] == "number" else float("-" + str(value()))
        if kind != "name":
            raise ValueError(f"a value was expected, not {x}")
        return {"true": True, "false": False, "inf": float("inf"), "nan": float("nan")}.get(x, x)

    def message(end):
        nonlocal place
        out: dict[str, list] = {}
        while place < len(tokens) and tokens[place][1] != end:
            kind, name = tokens[place]
            place += 1
            if name == "[":  # an extension
                name = tokens[place][1]
                place += 2
            elif kind != "name":
                raise ValueError(f"a field was expected, not {name}")
            if place < len(tokens) and tokens[place][1] == ":":
                place += 1
            if place >= len(tokens):
                raise ValueError(f"{name} has no value")
            if tokens[place][1] == "[":
                place += 1
                while tokens[place][1] != "]":
                    out.setdefault(name, []).append(value())
                    place += tokens[place][1] == ","
                place += 1
            else:
                out.setdefault(name, []).append(value())
            if place < len(tokens) and tokens[place][1] in ",;":
                place += 1
        if end is not None:
            if place >= len(tokens):
                raise ValueError("a message is not closed")
            place += 1
        return out

    return message(None)


def _one(m: dict, name: str, default=None):
    return m[name][-1] if m.get(name) else default


def _text(m: dict, name: str) -> str:
    x = _one(m, name, b"")
    return x.decode() if isinstance(x, bytes) else str(x)


def _shape(m: dict) -> tuple[int, ...]:
    return tuple(int(_one(d, "size", -1)) for d in m.get("dim", ()))


def _feature(m: dict) -> Feature:
    count, presence = _one(m, "value_count"), _one(m, "presence", {})
    shape = _one(m, "shape")
    return Feature(
        _text(m, "name"), _one(m, "type", "BYTES"), None if shape is None else _shape(shape),
        None if count is None else (int(_one(count, "min", 0)), int(_one(count, "max", 0))), float(_one(presence, "min_fraction", 0.0)),
        bool(_one(m, "deprecated", False)), _one(m, "lifecycle_stage", ""), bool(_one(m, "represent_variable_length_as_ragged", False)),
        tuple(_feature(f) for f in _one(m, "struct_domain", {}).get("feature", ())),
    )


def _steps(m: dict, column: str) -> tuple[str, ...]:
    path = _one(m, "feature_path")
    return tuple(s.decode() for s in path.get("step", ())) if path else (_text(m, column),)


def _representation(m: dict) -> Representation:
    (kind, (body, *_)), *more = m.items()
    if more:
        raise ValueError("a tensor has one representation")
    if kind == "dense_tensor":
        default = _one(body, "default_value", {})
        return Representation("dense", _steps(body, "column_name"), _shape(_one(body, "shape", {})), next((v[-1] for v in default.values()), None))
    if kind == "varlen_sparse_tensor":
        return Representation("varlen", _steps(body, "column_name"))
    if kind == "sparse_tensor":
        return Representation(
            "sparse", (_text(body, "value_column_name"),), indices=tuple(x.decode() for x in body.get("index_column_names", ())),
            sizes=_shape(_one(body, "dense_shape", {})), sorted=bool(_one(body, "already_sorted", False)),
        )
    if kind == "ragged_tensor":
        parts = []
        for p in body.get("partition", ()):
            parts.append(("lengths", _text(p, "row_length")) if "row_length" in p else ("uniform", int(_one(p, "uniform_row_length"))))
        return Representation("ragged", _steps(body, "column_name"), partitions=tuple(parts))
    raise ValueError(f"unknown representation {kind}")


def parse_schema(text: str) -> FeatureSchema:
    """A schema message in text form. `generate_legacy_feature_spec` asks for the older inference of tensors."""
    return schema_of(parse_text(text))


def schema_of(m: dict[str, list]) -> FeatureSchema:
    """The schema that a message holds, however it was written."""
    sparse = []
    for s in m.get("sparse_feature", ()):
        names = tuple(_text(i, "name") for i in s.get("index_feature", ()))
        sparse.append(SparseFeature(_text(s, "name"), names, _text(_one(s, "value_feature", {}), "name"), sorted=bool(_one(s, "is_sorted", False))))
    groups = {}
    for g in m.get("tensor_representation_group", ()):
        held = _one(g, "value", {}).get("tensor_representation", ())
        groups[_text(g, "key")] = {_text(t, "key"): _representation(_one(t, "value", {})) for t in held}
    features = [_feature(f) for f in m.get("feature", ())]
    if _one(m, "represent_variable_length_as_ragged", False):
        features = [replace(f, ragged=True) for f in features]
    return FeatureSchema(tuple(features), tuple(sparse), groups, bool(_one(m, "generate_legacy_feature_spec", False)))


def read_schema(spark, path: str) -> FeatureSchema:
    """A schema file in text form, from any store that Spark knows."""
    rows = spark.read.text(path, wholetext=True).collect()  # one file
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return parse_schema(rows[0][0])


def _quote(x) -> str:
    raw = x.encode() if isinstance(x, str) else x
    return '"' + "".join(chr(b) if 32 <= b < 127 and b not in (34, 92) else f"\\{b:03o}" for b in raw) + '"'


def _dims(shape) -> str:
    return " ".join(f"dim {{ size: {n} }}" for n in shape)


def _write_feature(f: Feature) -> str:
    out = [f"name: {_quote(f.name)} type: {f.type}"]
    if f.shape is not None:
        out.append(f"shape {{ {_dims(f.shape)} }}")
    if f.value_count is not None:
        out.append(f"value_count {{ min: {f.value_count[0]} max: {f.value_count[1]} }}")
    if f.min_fraction:
        out.append(f"presence {{ min_fraction: {f.min_fraction!r} }}")
    out += ["deprecated: true"] * f.deprecated + [f"lifecycle_stage: {f.stage}"] * bool(f.stage) + ["represent_variable_length_as_ragged: true"] * f.ragged
    if f.children:
        out.append("struct_domain { " + " ".join(f"feature {{ {_write_feature(c)} }}" for c in f.children) + " }")
    return " ".join(out)


def _column(r: Representation) -> str:
    return f"column_name: {_quote(r.column[0])}" if len(r.column) == 1 else "feature_path { " + " ".join(f"step: {_quote(s)}" for s in r.column) + " }"


def _write_representation(r: Representation) -> str:
    if r.kind == "dense":
        kind = {bytes: "bytes_value", int: "int_value", float: "float_value"}.get(type(r.default))
        default = "" if kind is None else f" default_value {{ {kind}: {_quote(r.default) if kind == 'bytes_value' else repr(r.default)} }}"
        return f"dense_tensor {{ {_column(r)} shape {{ {_dims(r.shape)} }}{default} }}"
    if r.kind == "varlen":
        return f"varlen_sparse_tensor {{ {_column(r)} }}"
    if r.kind == "sparse":
        names = " ".join(f"index_column_names: {_quote(i)}" for i in r.indices)
        return f"sparse_tensor {{ {names} value_column_name: {_quote(r.column[0])} dense_shape {{ {_dims(r.sizes)} }} already_sorted: {str(r.sorted).lower()} }}"
    parts = " ".join(f"partition {{ row_length: {_quote(a)} }}" if k == "lengths" else f"partition {{ uniform_row_length: {a} }}" for k, a in r.partitions)
    return f"ragged_tensor {{ {_column(r)} {parts} }}"


def format_schema(schema: FeatureSchema) -> str:
    """A schema in text form; parse_schema() reads it back."""
    out = ["generate_legacy_feature_spec: true"] * schema.legacy + [f"feature {{ {_write_feature(f)} }}" for f in schema.features]
    for s in schema.sparse:
        names = " ".join(f"index_feature {{ name: {_quote(i)} }}" for i in s.indices)
        out.append(f"sparse_feature {{ name: {_quote(s.name)} {names} value_feature {{ name: {_quote(s.value)} }} is_sorted: {str(s.sorted).lower()} }}")
    for g, held in schema.groups.items():
        rows = " ".join(f"tensor_representation {{ key: {_quote(n)} value {{ {_write_representation(r)} }} }}" for n, r in held.items())
        out.append(f"tensor_representation_group {{ key: {_quote(g)} value {{ {rows} }} }}")
    return "\n".join(out) + "\n"
