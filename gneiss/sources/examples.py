"""Example and sequence-example records to columns and back, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions import arrays
from gneiss.plans.features import SPARK_TYPES, FeatureSchema
from gneiss.sources import wire

SEQUENCE = "##SEQUENCE##"
BATCH_BYTES = 64 << 20  # of columns that are encoded at a time
PIECE_BYTES = 1 << 20  # of columns that are made into Python's objects at a time; these take ten times as much and more
_ARROW = {"INT": pa.int64(), "FLOAT": pa.float32(), "BYTES": pa.binary()}


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of at most `size` bytes, or of one row; halved until they fit, so that long rows stand alone."""
    for b in batches:
        todo = [b] if b.num_rows else []
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and b.nbytes > size:
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def infer_schema(records: DataFrame, column: str) -> dict[str, str | None]:
    """{feature: kind or None if never set}, sorted by name; two kinds for one feature are an error. One aggregate."""

    def run(batches):
        kinds: dict = {}
        for b in pieces(batches):
            for r in b.column(0).to_pylist():
                for name, (kind, _) in wire.parse_example(r).items():
                    kinds.setdefault(name, set()).add(kind)
        yield _kinds(kinds, "")

    return _merged_kinds(records.select(column).mapInArrow(run, "part string, name string, kind string"))[""]


def _kinds(kinds: dict, part: str) -> pa.RecordBatch:
    rows = [(part, n, k) for n, ks in kinds.items() for k in ks]
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["part", "name", "kind"])


def _merged_kinds(found: DataFrame) -> dict[str, dict]:
    out: dict[str, dict] = {"": {}, SEQUENCE: {}}
    rows = found.groupBy("part", "name").agg(F.collect_set("kind").alias("kinds")).collect()  # one row a feature
    for r in sorted(rows, key=lambda r: r["name"]):
        if len(r["kinds"]) > 1:
            raise ValueError(f"feature {r['name']} has values of several kinds: {', '.join(sorted(r['kinds']))}")
        out[r["part"]][r["name"]] = r["kinds"][0] if r["kinds"] else None
    return out


def _as_kinds(schema: FeatureSchema | dict | None) -> dict | None:
    return {f.name: f.type for f in schema.features} if isinstance(schema, FeatureSchema) else schema


def _fields_of(kinds: dict) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(SPARK_TYPES[k]) if k else T.NullType()) for n, k in kinds.items()]


def _column_of(values: list, name: str, kind: str | None) -> pa.Array:
    out = []
    for got in values:
        k, v = got if got is not None else (None, None)
        if k is not None and kind is not None and k != kind:
            raise ValueError(f"feature {name}: {k} values where {kind} was expected")
        out.append(v)
    return pa.array(out, pa.list_(_ARROW[kind])) if kind else pa.nulls(len(out))


def list_columns(records: pa.Array, kinds: dict[str, str]) -> list[pa.Array]:
    """A list column for each feature of a batch of example records."""
    try:
        return wire.columns(records, kinds)
    except wire.Irregular:
        parsed = [wire.parse_example(r, kinds) for r in records.to_pylist()]
        return [_column_of([p.get(n) for p in parsed], n, k) for n, k in kinds.items()]


def sequence_columns(records: list[bytes], context: dict[str, str], steps: dict[str, str]) -> tuple[list[pa.Array], pa.Array | None]:
    """A list column for each context feature of a batch of sequence-example records, and the struct of the others."""
    parsed = [wire.parse_sequence(r, context, steps) for r in records]
    made = [_column_of([c.get(n) for c, _ in parsed], n, k) for n, k in context.items()]
    parts = []
    for n, k in steps.items():
        lists = []
        for _, s in parsed:
            if any(kind is not None and kind != k for kind, _ in s.get(n) or ()):
                raise ValueError(f"feature {n}: values of another kind where {k} was expected")
            lists.append([v for _, v in s[n]] if n in s else None)
        parts.append(pa.array(lists, pa.list_(pa.list_(_ARROW[k]))))
    return made, pa.StructArray.from_arrays(parts, list(steps)) if steps else None


def decode_examples(records: DataFrame, column: str, schema: FeatureSchema | dict | None = None, raw_record: str | None = None, keep: list[str] = ()) -> DataFrame:
    """One list column for each feature of the schema, in its order; without a schema, of all features found.

    A feature that a record lacks, or whose kind is unset, is null; one without values is []. Only the schema's
    features are decoded: narrowing the schema is how columns are pruned. The raw record goes last, columns in keep
    first.
    """
    kinds = _as_kinds(schema)
    if kinds is None:
        kinds = infer_schema(records, column)
    if raw_record in kinds:
        raise ValueError(f"{raw_record} is a feature already")
    typed = {n: k for n, k in kinds.items() if k}
    kept = [records.schema[k] for k in keep]
    fields = kept + _fields_of(typed)
    if raw_record:
        fields.append(T.StructField(raw_record, T.ArrayType(T.BinaryType())))
    n_keep = len(kept)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in pieces(batches):
            record = b.column(n_keep)
            made = list_columns(record, typed)
            cols = [b.column(i) for i in range(n_keep)] + made
            if raw_record:
                cols.append(pa.ListArray.from_arrays(pa.array(range(len(record) + 1), pa.int32()), record))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    out = records.select(*keep, column).mapInArrow(run, T.StructType(fields))
    order = [*keep, *kinds, *([raw_record] if raw_record else [])]
    return out.select(*[F.col(f"`{n}`") if n in out.columns else F.lit(None).alias(n) for n in order])


def infer_sequence_schema(records: DataFrame, column: str) -> tuple[dict, dict]:
    """Kinds of the context features, and of the sequence features."""

    def run(batches):
        context: dict = {}
        steps: dict = {}
        for b in pieces(batches):
            for r in b.column(0).to_pylist():
                c, s = wire.parse_sequence(r)
                for name, (kind, _) in c.items():
                    context.setdefault(name, set()).add(kind)
                for name, fs in s.items():
                    steps.setdefault(name, set()).update([k for k, _ in fs] or [None])
        yield _kinds(context, "")
        yield _kinds(steps, SEQUENCE)

    found = _merged_kinds(records.select(column).mapInArrow(run, "part string, name string, kind string"))
    return found[""], found[SEQUENCE]


def decode_sequences(records: DataFrame, column: str, context: dict | FeatureSchema | None = None, steps: dict | None = None, sequence: str = SEQUENCE, raw_record: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Context features as by decode_examples(), and a struct of lists of lists as the last column.

    A sequence feature that a record lacks is null, one without steps []; a step whose kind is unset is a null step.
    """
    if isinstance(context, FeatureSchema):
        held = context.feature(sequence)
        if held is not None and held.type != "STRUCT":
            raise ValueError(f"{sequence} must be a STRUCT in the schema")
        steps = {c.name: c.type for c in held.children} if held else {}
        context = {f.name: f.type for f in context.features if f.name != sequence}
    if context is None:
        context, steps = infer_sequence_schema(records, column)
    steps = steps or {}
    typed, typed_steps = {n: k for n, k in context.items() if k}, {n: k for n, k in steps.items() if k}
    kept = [records.schema[k] for k in keep]
    inner = T.StructType([T.StructField(n, T.ArrayType(T.ArrayType(SPARK_TYPES[k]))) for n, k in typed_steps.items()])
    fields = kept + _fields_of(typed)
    if raw_record:
        fields.append(T.StructField(raw_record, T.ArrayType(T.BinaryType())))
    if typed_steps:
        fields.append(T.StructField(sequence, inner))
    n_keep = len(kept)

    def run(batches):
        for b in pieces(batches):
            raw = b.column(n_keep).to_pylist()
            made, held = sequence_columns(raw, typed, typed_steps)
            cols = [b.column(i) for i in range(n_keep)] + made
            if raw_record:
                cols.append(pa.array([[r] for r in raw], pa.list_(pa.binary())))
            if held is not None:
                cols.append(held)
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    out = records.select(*keep, column).mapInArrow(run, T.StructType(fields))
    order = [*keep, *context, *([raw_record] if raw_record else []), *([sequence] if typed_steps else [])]
    return out.select(*[F.col(f"`{n}`") if n in out.columns else F.lit(None).alias(n) for n in order])


def example_to_numpy(record: bytes) -> dict:
    """One record as {feature: 1-D array, or None if unset}."""
    kinds = {"INT": np.int64, "FLOAT": np.float32, "BYTES": object}
    return {n: None if k is None else np.array(v, dtype=kinds[k]) for n, (k, v) in wire.parse_example(record).items()}


def _kind_of(kind: T.DataType, name: str) -> str:
    leaf = arrays.innermost_type(kind)
    for k, types in (("INT", (T.LongType, T.IntegerType, T.ShortType, T.ByteType)), ("FLOAT", (T.FloatType,)), ("BYTES", arrays.TEXT)):
        if isinstance(leaf, types) and arrays.is_list_like(kind):
            return k
    raise TypeError(f"{name}: records hold lists of whole numbers, float or text, not {kind.simpleString()}")


def _features_of(column: pa.Array, name: str, kind: str | None, spec: tuple | None) -> list[wire.ListFeature]:
    """The features that a list column is written as: its values, and row lengths of the levels that have them."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = lambda x: pa.compute.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)
    ends = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int64)
    if kind is None:
        return [wire.ListFeature(name, None, valid, np.zeros(len(column) + 1, np.int64), None)]
    offsets, level, lengths = ends(sizes(column)), column.flatten(), []
    for how, f in spec[1] if spec else ():
        if level.null_count:
            raise ValueError(f"{name}: a null within a list")
        inner = sizes(level)
        if how == "lengths":
            lengths.append(wire.ListFeature(f, "INT", valid, offsets, pa.array(inner, pa.int64())))
        elif (inner != f).any():
            raise ValueError(f"{name}: lists of other length than {f}")
        offsets, level = ends(inner)[offsets], level.flatten()
    return [wire.ListFeature(spec[0] if spec else name, kind, valid, offsets, level), *lengths]


def encode_examples(df: DataFrame, record: str = "record", partitions: dict[str, tuple] | None = None, keep: list[str] = ()) -> DataFrame:
    """One example record for each row; a null list is a feature whose kind is unset.

    A nested list needs partitions[column] = (values feature, partitions): ("lengths", feature) for each list level
    outside in, or ("uniform", n); row lengths are written flat, divided by the uniform sizes inside them.
    """
    columns = [c for c in df.columns if c not in keep]
    if len(set(columns)) != len(columns):
        raise ValueError("two columns have one name")
    partitions = partitions or {}
    kinds, made = {}, []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.NullType):
            kinds[c] = None
            made.append(c)
            continue
        kinds[c], levels = _kind_of(kind, c), arrays.depth(kind)
        spec = partitions.get(c)
        if levels > 1 and spec is None:
            raise ValueError(f"{c}: a nested list needs partitions")
        if spec is not None:
            if len(spec[1]) != levels - 1:
                raise ValueError(f"{c}: {levels - 1} levels, but {len(spec[1])} partitions")
            made += [spec[0], *[f for k, f in spec[1] if k == "lengths"]]
        else:
            made.append(c)
    if len(set(made)) != len(made):
        raise ValueError("two features have one name")

    n_keep = len(keep)

    def run(batches):
        for whole in batches:
            step = max(1, whole.num_rows * BATCH_BYTES // max(1, whole.nbytes))
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                features = [f for i, c in enumerate(columns) for f in _features_of(b.column(n_keep + i), c, kinds[c], partitions.get(c))]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n_keep)], wire.build_examples(b.num_rows, features)], [*keep, record])

    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField(record, T.BinaryType())])
    typed = [F.col(c).cast("array<string>") if isinstance(df.schema[c].dataType, T.NullType) else F.col(c) for c in columns]
    return df.select(*keep, *typed).mapInArrow(run, schema)


def sequence_bytes(columns: list[pa.Array], names: list[str], kinds: dict[str, str], inner: dict[str, str]) -> list[bytes]:
    """Sequence-example records of context columns and, as the last column, the struct of lists of lists."""
    out = []
    for *context, steps in zip(*[c.to_pylist() for c in columns]):
        c = {n: (kinds[n] if v is not None else None, v) for n, v in zip(names, context)}
        s = {n: [(inner[n] if x is not None else None, x) for x in v] for n, v in (steps or {}).items() if v is not None}
        out.append(wire.build_sequence(c, s))
    return out


def encode_sequences(df: DataFrame, sequence: str = SEQUENCE, record: str = "record", keep: list[str] = ()) -> DataFrame:
    """Sequence-example records of context list columns and a struct of lists of lists."""
    columns = [c for c in df.columns if c not in keep and c != sequence]
    kinds = {c: _kind_of(df.schema[c].dataType, c) for c in columns}
    inner = {f.name: _kind_of(f.dataType, f.name) for f in df.schema[sequence].dataType.fields}
    n_keep = len(keep)

    def run(batches):
        for b in pieces(batches):
            out = sequence_bytes([b.column(n_keep + i) for i in range(len(columns) + 1)], columns, kinds, inner)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n_keep)], pa.array(out, pa.binary())], [*keep, record])

    return df.select(*keep, *columns, sequence).mapInArrow(run, T.StructType([*[df.schema[k] for k in keep], T.StructField(record, T.BinaryType())]))


class RecordDecoder:
    """A decoder of one's own: output_schema(), and decode(records) giving a dict of lists aligned with the records.

    If record_index names an output, it tells for each output row which record it came from, and outputs may be
    longer or shorter than the records.
    """

    record_index: str | None = None

    def output_schema(self) -> T.StructType:
        raise NotImplementedError

    def decode(self, records: list[bytes]) -> dict[str, list]:
        raise NotImplementedError

    def check(self) -> None:
        if self.record_index is not None and (not self.record_index or self.record_index not in self.output_schema().fieldNames()):
            raise ValueError("the record index must be one of the outputs")


def save_decoder(decoder: RecordDecoder, path: str) -> None:
    """A decoder in a file, definition included."""
    from pyspark import cloudpickle

    decoder.check()
    with open(path, "wb") as f:
        f.write(cloudpickle.dumps(decoder))


def load_decoder(path: str) -> RecordDecoder:
    from pyspark import cloudpickle

    with open(path, "rb") as f:
        return cloudpickle.loads(f.read())


def decode_with(records: DataFrame, column: str, decoder: RecordDecoder, raw_record: str | None = None) -> DataFrame:
    """Rows that a decoder makes of raw records, with their record if asked for."""
    decoder.check()
    schema = decoder.output_schema()
    if raw_record in schema.fieldNames():
        raise ValueError(f"{raw_record} is an output already")
    full = T.StructType([*schema.fields, *([T.StructField(raw_record, T.ArrayType(T.BinaryType()))] if raw_record else [])])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for b in batches:
            raw = b.column(0).to_pylist()
            out = dict(decoder.decode(raw))
            n = {len(v) for v in out.values()}
            if len(n) > 1 or (decoder.record_index is None and n and n != {len(raw)}):
                raise ValueError("outputs are not aligned with the records")
            if raw_record:
                if decoder.record_index is None:
                    out[raw_record] = [[r] for r in raw]
                else:
                    index = out[decoder.record_index]
                    if any(i is None or (isinstance(i, (list, tuple)) and len(i) != 1) for i in index):
                        raise ValueError("a record index is one number for each row")
                    out[raw_record] = [[raw[i[0] if isinstance(i, (list, tuple)) else i]] for i in index]
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return records.select(column).mapInArrow(run, full)


def raw_record_column(c: str) -> Column:
    """[record]."""
    return F.array(c)


def append_raw_record(df: DataFrame, name: str, record: str) -> DataFrame:
    """C14: df with its raw record last, as a list of one; the name must be new."""
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    return df.withColumn(name, F.array(record)) if record == name else df.select(*[c for c in df.columns if c != record], F.array(record).alias(name))


def append_indexed_records(df: DataFrame, name: str, index: str, records: DataFrame, pos: str, record: str) -> DataFrame:
    """C14: the record that a row's index column (a list of one number) points at, joined from records(pos, record)."""
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    kind = df.schema[index].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.LongType, T.IntegerType))):
        raise TypeError(f"{index} must be a list of whole numbers")
    bad = F.col(index).isNull() | (F.size(index) != 1)
    at = F.when(bad, F.raise_error(F.lit(f"{index} must hold one number in each row")).cast("bigint")).otherwise(F.get(index, 0).cast("bigint"))
    side = records.select(F.col(pos).cast("bigint").alias("_p"), F.array(record).alias(name))
    return df.withColumn("_at", at).join(side, F.col("_at") == F.col("_p")).drop("_at", "_p")
