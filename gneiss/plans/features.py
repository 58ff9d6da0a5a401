"""Feature schemas (D8) and tensor representations (D9): T1-T9, driver-side metadata."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: Lifecycle stages whose features have no tensors.
SKIPPED_STAGES = ("DEPRECATED", "DISABLED", "PLANNED", "ALPHA", "DEBUG_ONLY", "VALIDATION_DERIVED")

#: Default values of missing features by type.
DEFAULTS = {"BYTES": b"", "INT": -1, "FLOAT": -1.0}

SPARK_TYPES = {"INT": T.LongType(), "FLOAT": T.FloatType(), "BYTES": T.BinaryType()}


@dataclass(frozen=True)
class Feature:
    """name, type (INT, FLOAT, BYTES, STRUCT), and what is known of shape and presence."""

    name: str
    type: str = "BYTES"
    shape: tuple[int, ...] | None = None
    value_count: tuple[int, int] | None = None  # (min, max), max 0: no limit
    min_fraction: float = 0.0
    deprecated: bool = False
    stage: str = ""
    ragged: bool = False
    children: tuple["Feature", ...] = ()


@dataclass(frozen=True)
class SparseFeature:
    name: str
    indices: tuple[str, ...]
    value: str
    sizes: tuple[int, ...] = ()
    sorted: bool = True


@dataclass(frozen=True)
class Representation:
    """How columns become one tensor: kind is dense, varlen, sparse or ragged."""

    kind: str
    column: tuple[str, ...]  # path of the value column
    shape: tuple[int, ...] = ()
    default: object = None
    indices: tuple[str, ...] = ()
    sizes: tuple[int, ...] = ()
    sorted: bool = True
    partitions: tuple = ()  # of ragged: ("lengths", column) or ("uniform", n)


@dataclass(frozen=True)
class FeatureSchema:
    features: tuple[Feature, ...] = ()
    sparse: tuple[SparseFeature, ...] = ()
    groups: dict[str, dict[str, Representation]] = field(default_factory=dict)
    legacy: bool = False  # tensors are inferred by value counts (T2)

    def feature(self, name: str) -> Feature | None:
        return next((f for f in self.features if f.name == name), None)

    def spark_type(self) -> T.StructType:
        """The decoded columns: one list for each feature, a struct of lists of lists for a STRUCT."""
        return T.StructType([T.StructField(f.name, _column(f)) for f in self.features])


def _column(f: Feature, level: int = 1) -> T.DataType:
    if f.type == "STRUCT":
        return T.StructType([T.StructField(c.name, _column(c, 2)) for c in f.children])
    if f.type not in SPARK_TYPES:
        raise ValueError(f"{f.name}: unknown type {f.type}")
    kind: T.DataType = SPARK_TYPES[f.type]
    for _ in range(level):
        kind = T.ArrayType(kind)
    return kind


def _used(f: Feature) -> bool:
    return not f.deprecated and f.stage not in SKIPPED_STAGES


def infer_representations(schema: FeatureSchema) -> dict[str, Representation]:
    """Sparse features first, which take their columns; STRUCT children ragged; a shape dense; the rest varlen.

    A schema that asks for the older rules gets those of infer_legacy().
    """
    if schema.legacy:
        return infer_legacy(schema)
    out: dict[str, Representation] = {}
    taken: set[str] = set()
    for s in schema.sparse:
        for c in (*s.indices, s.value):
            if schema.feature(c) is None:
                raise ValueError(f"{s.name} names an unknown column {c}")
        if any(schema.feature(i).type != "INT" for i in s.indices):
            raise ValueError(f"{s.name}: index columns must be INT")
        taken |= {*s.indices, s.value}
        out[s.name] = Representation("sparse", (s.value,), indices=s.indices, sizes=s.sizes or tuple(-1 for _ in s.indices), sorted=s.sorted)
    for f in schema.features:
        if f.name in taken or not _used(f):
            continue
        if f.type == "STRUCT":
            out |= {f"{f.name}.{c.name}": Representation("ragged", (f.name, c.name)) for c in f.children if _used(c)}
        elif f.shape is not None:
            if f.min_fraction != 1:
                raise ValueError(f"{f.name}: a feature with a shape must always be present")
            out[f.name] = Representation("dense", (f.name,), shape=tuple(f.shape))
        else:
            out[f.name] = Representation("ragged" if f.ragged else "varlen", (f.name,))
    return out


def infer_legacy(schema: FeatureSchema) -> dict[str, Representation]:
    """By value_count: one value a scalar, a fixed number a vector, else varlen; a default where values may miss."""
    out = {}
    for f in schema.features:
        if not _used(f):
            continue
        if f.type == "STRUCT":
            out |= {f"{f.name}.{c.name}": Representation("ragged", (f.name, c.name)) for c in f.children if _used(c)}
            continue
        low, high = f.value_count or (0, 0)
        if low < 0 or high < 0:
            raise ValueError(f"{f.name}: value counts can't be negative")
        if low == high and low > 0:
            default = DEFAULTS[f.type] if f.min_fraction < 1 else None
            out[f.name] = Representation("dense", (f.name,), shape=() if low == 1 else (low,), default=default)
        else:
            out[f.name] = Representation("ragged" if f.ragged else "varlen", (f.name,))
    return out


def infer_mixed(schema: FeatureSchema, group: str = "") -> dict[str, Representation]:
    """Explicit representations, and inferred ones for columns that no explicit one uses."""
    explicit = get_representations(schema, group) or {}
    used = {c for r in explicit.values() for c in source_columns(r)}
    out = {}
    for name, r in infer_representations(schema).items():
        if set(source_columns(r)) & used:
            continue
        if name in explicit:
            warnings.warn(f"{name} is also represented explicitly, which counts", stacklevel=2)
            continue
        out[name] = r
    return out | explicit


def get_representations(schema: FeatureSchema, group: str = "") -> dict[str, Representation] | None:
    """T4."""
    return schema.groups.get(group)


def set_representations(schema: FeatureSchema, representations: dict[str, Representation], group: str = "") -> FeatureSchema:
    """T4: a schema whose group is replaced."""
    return replace(schema, groups={**schema.groups, group: dict(representations)})


def source_columns(r: Representation) -> list[tuple[str, ...]]:
    """T5: paths of all columns that a representation reads; row lengths are siblings of the values."""
    out = [(i,) for i in r.indices] + [tuple(r.column)]
    return out + [(*r.column[:-1], c) for kind, c in r.partitions if kind == "lengths"]


def source_value_column(r: Representation) -> tuple[str, ...]:
    """T5: the path of the value column."""
    return tuple(r.column)


def project(schema: FeatureSchema, names: list[str], group: str = "") -> FeatureSchema:
    """The least schema that has the tensors of some names."""
    have = get_representations(schema, group) or infer_representations(schema)
    if unknown := [n for n in names if n not in have]:
        raise ValueError(f"no such tensor: {', '.join(unknown)}")
    keep = {n: have[n] for n in names}
    paths = {c for r in keep.values() for c in source_columns(r)}
    heads = {p[0] for p in paths}
    if missing := heads - {f.name for f in schema.features}:
        raise ValueError(f"columns are not in the schema: {', '.join(sorted(missing))}")
    features = []
    for f in schema.features:
        if f.name in heads:
            features.append(replace(f, children=tuple(c for c in f.children if (f.name, c.name) in paths)) if f.type == "STRUCT" else f)
    return FeatureSchema(tuple(features), tuple(s for s in schema.sparse if s.name in keep), {group: keep}, schema.legacy)


def validate_representations(schema: FeatureSchema, group: str = "") -> None:
    """Every feature is used by some representation, and every column that one uses exists."""
    have = get_representations(schema, group)
    if have is None:
        raise ValueError("no representations in the schema")
    used = {c for r in have.values() for c in source_columns(r)}
    there = {(f.name, c.name) for f in schema.features for c in f.children} | {(f.name,) for f in schema.features if f.type != "STRUCT"}
    if used - there:
        raise ValueError(f"not in the schema: {sorted(used - there)}")
    if there - used:
        raise ValueError(f"in no representation: {sorted(there - used)}")


@dataclass(frozen=True)
class ParseSpec:
    """How a parser of records reads one tensor: fixed, varlen, sparse or ragged."""

    kind: str
    type: str
    keys: tuple[str, ...]
    shape: tuple[int, ...] = ()
    default: tuple | None = None
    sizes: tuple[int, ...] = ()
    partitions: tuple = ()


def parse_spec(r: Representation, kind: str) -> ParseSpec:
    """T8."""
    if kind not in SPARK_TYPES:
        raise ValueError(f"unknown feature type {kind}")
    if r.kind == "dense":
        n = 1
        for d in r.shape:
            n *= d
        default = None
        if r.default is not None:
            check_default(r.default, kind)
            default = (r.default,) * n
        return ParseSpec("fixed", kind, r.column, r.shape, default)
    if len(r.column) > 1:
        raise ValueError("nested paths have no parse specification")
    if r.kind == "sparse":
        return ParseSpec("sparse", kind, (*r.indices, *r.column), sizes=r.sizes)
    return ParseSpec("varlen" if r.kind == "varlen" else "ragged", kind, r.column, partitions=r.partitions)


def check_default(value, kind: str) -> None:
    """A default must be of the feature's type and in its range."""
    want = {"BYTES": (bytes,), "INT": (int,), "FLOAT": (float, int)}[kind]
    if isinstance(value, bool) or not isinstance(value, want):
        raise ValueError(f"default {value!r} is not {kind}")
    if kind == "INT" and not -(2**63) <= value < 2**63:
        raise ValueError(f"default {value} is out of range")


def sequence_parse_specs(schema: FeatureSchema, sequence: str = "##SEQUENCE##") -> tuple[dict, dict]:
    """Parse specifications of the context features, and of the sequence features."""
    context, steps = {}, {}
    for name, r in infer_representations(schema).items():
        f = schema.feature(r.column[0])
        if f.type == "STRUCT":
            child = next(c for c in f.children if c.name == r.column[1])
            steps[child.name] = ParseSpec("ragged", child.type, (child.name,), partitions=(("lengths", None),))
        else:
            context[name] = parse_spec(r, f.type)
    return context, steps


INTERNAL_PREFIX = "_parse_"


def parse_config(schema: FeatureSchema, representations: dict[str, Representation] | None = None) -> dict[str, ParseSpec]:
    """Specifications by feature; tensors of several columns go under an internal name; no column is parsed twice."""
    out: dict[str, ParseSpec] = {}
    seen: set[str] = set()
    for name, r in (representations or infer_representations(schema)).items():
        spec = parse_spec(r, schema.feature(r.column[0]).type)
        for k in spec.keys:
            if k in seen:
                raise ValueError(f"feature {k} is used by more than one tensor")
            seen.add(k)
        out[f"{INTERNAL_PREFIX}{name}" if len(spec.keys) > 1 or spec.partitions else spec.keys[0]] = spec
    return out
