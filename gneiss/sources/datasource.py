"""Record files as Spark data sources, read and written by format: S1, S3, S8, S14 and their sink.

    datasource.register(spark)
    spark.read.format("record_examples").schema("id long, tags array<string>").load("/data/part-*")
    datasource.read(spark, "examples", "/data/part-*", "id long, tags array<string>", where=[("id", ">", 5), ("tags", "is not null")])
    df.write.format("record_examples").mode("append").save("/data/out")

`record_examples` holds example records, `record_sequences` sequence-example records (the steps in a struct column named
by the option `sequence`), `record_bytes` records as they are (column `record`).

Reading: files are listed once and dealt to partitions by size, small ones together, large ones apart, so that all
partitions hold about as much. The schema prunes columns: only its features are decoded. A feature is a list, or a
plain value if the schema says so (null if there is none, an error if there are several). Columns named _file, _pos and _record
give a record's file, place in it and bytes. Conditions on whole numbers and texts, and tests for null, can be given to the
scan (option `where`, or read()): their columns are decoded first, the others only for records that pass; files that
_file excludes aren't opened. Spark's own pushdown into Python sources isn't used, since in 4.1 the filters of one query
stay with the source for others over the same DataFrame, which then lack rows.

Writing: a task writes to a file of its own attempt in a folder for the job, and says so in its commit message. Only when
all tasks are done does the driver move the files named there to their places, so tasks that are run again, or twice at
once, leave no second copy; an aborted job leaves nothing. Overwriting takes away old files just before that.
"""

from __future__ import annotations

import fnmatch
import heapq
import json
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from gneiss.functions import arrays
from gneiss.sources import examples, wire
from gneiss.sources.records import _opened, _store

PARTITION_BYTES, OPEN_BYTES = 128 << 20, 4 << 20
INFER_RECORDS = 1000
OWN = {"_file": T.StringType(), "_pos": T.LongType(), "_record": T.BinaryType()}
_COMPARE = {"=": pc.equal, "!=": pc.not_equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's files, or of those that a pattern names; hidden ones are left out."""
    from pyarrow import fs

    store, name = _store(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    magic = re.search(r"[*?\[]", name)
    if not magic:
        info = store.get_file_info(name)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
    base = name[: magic.start()].rpartition("/")[0] if magic else name.rstrip("/")
    found = store.get_file_info(fs.FileSelector(base or "/", recursive=bool(magic), allow_not_found=True))
    wanted = name.split("/")
    fits = lambda p: len(p) == len(wanted) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(p, wanted))
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and (not magic or fits(f.path.split("/")))]
    return sorted((prefix + f.path, f.size) for f in files)


def planned(files: list[tuple[str, int]], limit: int = PARTITION_BYTES, opening: int = OPEN_BYTES) -> list[list[str]]:
    """Files dealt to partitions of about equal size: the largest first, each to the emptiest partition."""
    cost = [(size + opening, path) for path, size in files]
    total = sum(c for c, _ in cost)
    heap = [(0, i) for i in range(max(1, -(-total // limit)))]
    parts: list[list[str]] = [[] for _ in heap]
    for c, path in sorted(cost, key=lambda x: (-x[0], x[1])):
        held, i = heapq.heappop(heap)
        parts[i].append(path)
        heapq.heappush(heap, (held + c, i))
    return [p for p in parts if p]


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


def _first(column: pa.Array, name: str) -> pa.Array:
    """The value of lists of at most one."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    if (size > 1).any():
        raise ValueError(f"feature {name} has several values; its column must be a list")
    at = np.cumsum(size) - size
    return column.flatten().take(pa.array(at, mask=size == 0))


def _plain(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.StructType))


def _kind(kind: T.DataType, name: str) -> str:
    return examples._kind_of(T.ArrayType(kind) if _plain(kind) else kind, name)


class Reader(ds.DataSourceReader):
    def __init__(self, form: str, schema: T.StructType, options: dict):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.form, self.schema, self.path = form, schema, options["path"]
        self.verify = str(options.get("verify", "true")).lower() == "true"
        self.limit, self.opening = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("openbytes", OPEN_BYTES))
        self.sequence = options.get("sequence", examples.SEQUENCE)
        own = OWN | ({"record": T.BinaryType()} if form == "bytes" else {})
        self.features = {f.name: f.dataType for f in schema.fields if f.name not in own and not (form == "sequences" and f.name == self.sequence)}
        for f in schema.fields:
            if f.name in own and f.dataType != own[f.name]:
                raise TypeError(f"{f.name} is of type {own[f.name].simpleString()}")
        if form == "bytes" and self.features:
            raise TypeError(f"records undecoded have no column {next(iter(self.features))}")
        self.kinds = {n: _kind(t, n) for n, t in self.features.items()}
        self.where = [self._condition(*c) for c in json.loads(options.get("where", "[]"))]

    def _condition(self, name: str, how: str, value=None) -> tuple:
        kind = next((x.dataType for x in self.schema.fields if x.name == name), None)
        if kind is None:
            raise ValueError(f"{name} is no column of the schema")
        if how in ("is null", "is not null"):
            if name not in self.features and name not in OWN:
                raise ValueError(f"{name} can't be tested for null")
        elif how not in _COMPARE and how != "in":
            raise ValueError(f"no condition {how}")
        elif not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType)):
            raise TypeError(f"{name}: whole numbers and texts are compared, not {kind.simpleString()}")
        return name, how, value

    def _passes(self, how: str, value, column: pa.Array) -> np.ndarray:
        """Which rows meet a condition; a comparison with null is met by none."""
        if how in ("is null", "is not null"):
            out = column.is_null() if how == "is null" else column.is_valid()
        elif how == "in":
            out = pc.if_else(column.is_valid(), pc.is_in(column, pa.array([v for v in value if v is not None], column.type)), None)
        else:
            out = _COMPARE[how](column, pa.scalar(value, column.type))
        return pc.fill_null(out, False).to_numpy(zero_copy_only=False)

    def partitions(self):
        files = list_files(self.path)
        for name, how, value in self.where:
            if files and name == "_file":
                files = [x for x, k in zip(files, self._passes(how, value, pa.array([p for p, _ in files]))) if k]
        return [Files(p) for p in planned(files, self.limit, self.opening)]

    def _columns(self, names: list[str], records: pa.Array, path: str, pos: np.ndarray) -> dict[str, pa.Array]:
        """Some columns of records at hand."""
        own = {"_file": lambda: pa.array([path] * len(records), pa.string()), "_pos": lambda: pa.array(pos), "_record": lambda: records}
        if self.form == "bytes":
            own["record"] = own["_record"]
        kinds = {n: self.kinds[n] for n in names if n in self.kinds}
        if self.form == "sequences":
            steps = {f.name: examples._kind_of(f.dataType, f.name) for f in self.schema[self.sequence].dataType.fields} if self.sequence in names else {}
            lists, held = examples.sequence_columns(records.to_pylist(), kinds, steps)
            own[self.sequence] = lambda: held
        else:
            lists = examples.list_columns(records, kinds) if kinds else []
        out = dict(zip(kinds, lists))
        out = {n: _first(c, n) if _plain(self.features[n]) else c for n, c in out.items()}
        return {n: out[n] if n in out else own[n]() for n in names}

    def read(self, partition: Files):
        schema = _arrow(self.schema)
        tested = list(dict.fromkeys(name for name, _, _ in self.where))
        rest = [n for n in schema.names if n not in tested]
        for path in partition.paths if partition is not None else ():  # Spark asks so where there are no partitions
            at = 0
            with _opened(path) as source:
                for part in wire.stream_records(source, self.verify):
                    records, pos = pa.array(part, pa.binary()), np.arange(at, at + len(part))
                    at += len(part)
                    columns = self._columns(tested, records, path, pos)
                    columns = {n: c.cast(schema.field(n).type) for n, c in columns.items()}
                    if self.where:
                        keep = np.ones(len(records), bool)
                        for name, how, value in self.where:
                            keep &= self._passes(how, value, columns[name])
                        if not keep.any():
                            continue
                        if not keep.all():
                            mask = pa.array(keep)
                            records, pos, columns = records.filter(mask), pos[keep], {n: c.filter(mask) for n, c in columns.items()}
                    columns |= self._columns(rest, records, path, pos)
                    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


@dataclass
class Written(ds.WriterCommitMessage):
    file: str | None
    records: int


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, form: str, schema: T.StructType, options: dict, overwrite: bool):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.form, self.schema, self.path, self.overwrite = form, schema, options["path"].rstrip("/"), overwrite
        self.compress = str(options.get("compression", "none")).lower() == "gzip"
        self.sequence = options.get("sequence", examples.SEQUENCE)
        self.job = uuid.uuid4().hex
        names = schema.fieldNames()
        if form == "bytes":
            if names != ["record"] or schema["record"].dataType != T.BinaryType():
                raise TypeError("records undecoded are one column: record binary")
            return
        if form == "sequences" and self.sequence not in names:
            raise TypeError(f"the steps go to a struct column named {self.sequence}")
        self.kinds = {f.name: None if isinstance(f.dataType, T.NullType) else _kind(f.dataType, f.name) for f in schema.fields if f.name != self.sequence}
        for f in schema.fields:
            if f.name in self.kinds and arrays.depth(f.dataType) > 1:
                raise TypeError(f"{f.name}: a nested list is written by encode_examples() with partitions")

    def _lists(self, batch: pa.RecordBatch, name: str) -> pa.Array:
        column = batch.column(name)
        if not _plain(self.schema[name].dataType) or self.kinds[name] is None:
            return column
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(valid)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), column.drop_null(), mask=pa.array(~valid))

    def _records(self, batch: pa.RecordBatch) -> list[bytes]:
        if self.form == "bytes":
            return batch.column(0).to_pylist()
        lists = {n: self._lists(batch, n) for n in self.kinds}
        if self.form == "examples":
            features = [f for n, c in lists.items() for f in examples._features_of(c, n, self.kinds[n], None)]
            return wire.build_examples(batch.num_rows, features).to_pylist()
        inner = {f.name: examples._kind_of(f.dataType, f.name) for f in self.schema[self.sequence].dataType.fields}
        return examples.sequence_bytes([*lists.values(), batch.column(self.sequence)], list(lists), self.kinds, inner)

    def write(self, iterator) -> Written:
        store, root = _store(self.path)
        task = TaskContext.get()
        part, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        name, n, out = f"_temporary-{self.job}/part-{part:05d}-{attempt}-{uuid.uuid4().hex[:8]}.rec", 0, None
        packer = zlib.compressobj(wbits=31) if self.compress else None
        try:
            for b in examples.pieces(iterator):
                records = self._records(b)
                if out is None:
                    store.create_dir(f"{root}/_temporary-{self.job}", recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                data = wire.frame(records)
                out.write(packer.compress(data) if packer else data)
                n += len(records)
            if out is not None and packer:
                out.write(packer.flush())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, n)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        old = [p for p, _ in list_files(self.path)] if self.overwrite else []
        for p in old:
            store.delete_file(_store(p)[1])
        for m in messages:
            if m is not None and m.file:
                part = re.search(r"part-(\d+)", m.file).group(1)
                store.move(f"{root}/{m.file}", f"{root}/part-{part}-{self.job}.rec{'.gz' if self.compress else ''}")
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        folder = f"{root}/_temporary-{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class Records(ds.DataSource):
    form = "bytes"

    @classmethod
    def name(cls) -> str:
        return f"record_{cls.form}"

    def schema(self) -> T.StructType:
        """That of records undecoded; for others the features of the first records (option inferrecords, 1000 by default)."""
        if self.form == "bytes":
            return T.StructType([T.StructField("record", T.BinaryType())])
        left, found = int(self.options.get("inferrecords", INFER_RECORDS)), {"": {}, "steps": {}}
        for path, _ in list_files(self.options["path"]):
            with _opened(path) as source:
                for part in wire.stream_records(source, size=1 << 18):
                    for r in part[:left]:
                        context, steps = (wire.parse_example(r), {}) if self.form == "examples" else wire.parse_sequence(r)
                        for n, (k, _) in context.items():
                            found[""].setdefault(n, set()).add(k)
                        for n, values in steps.items():
                            found["steps"].setdefault(n, set()).update(k for k, _ in values)
                    left -= len(part)
                    if left <= 0:
                        break
            if left <= 0:
                break
        fields = {}
        for place, features in found.items():
            fields[place] = []
            for n in sorted(features):
                kinds = features[n] - {None}
                if len(kinds) > 1:
                    raise ValueError(f"feature {n} has values of several kinds")
                if kinds:  # a feature that is never set has no type
                    kind = T.ArrayType(examples.SPARK_TYPES[kinds.pop()])
                    fields[place].append(T.StructField(n, T.ArrayType(kind) if place else kind))
        steps = [T.StructField(self.options.get("sequence", examples.SEQUENCE), T.StructType(fields["steps"]))] if fields["steps"] else []
        return T.StructType([*fields[""], *steps])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.form, schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.form, schema, dict(self.options), overwrite)


class Examples(Records):
    form = "examples"


class Sequences(Records):
    form = "sequences"


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (Records, Examples, Sequences):
        spark.dataSource.register(source)


def read(spark: SparkSession, form: str, path: str, schema: T.StructType | str | None = None, where: list[tuple] = (), **options) -> DataFrame:
    """The records of some files: examples, sequences or bytes. `where` are conditions that all must hold: (column, how, value)
    with how =, !=, <, <=, >, >= or in, or (column, "is null") and (column, "is not null")."""
    register(spark)
    reader = spark.read.format(f"record_{form}").options(**options).option("where", json.dumps([list(c) for c in where]))
    return (reader.schema(schema) if schema is not None else reader).load(path)
