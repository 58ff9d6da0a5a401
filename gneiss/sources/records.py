"""Record files: S1, S3, S8, S9, S12-S14, S18, and their sink.

Spark lists the files of a pattern and deals them to tasks by size, without reading them; a task then streams each of
its files through pyarrow's file systems, some MB at a time, so a file may be of any size. Checksums are verified unless
that is turned off. Writing is one file for each task, moved to its name when it is complete.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.plans.features import FeatureSchema
from gneiss.sources import examples, wire

MIXED = "INVALID_MIXED_COMPRESSION_TYPES"


def detect_compression(files: list[str]) -> str:
    """GZIP if all names end in .gz, "" if none does (or there is none), else MIXED."""
    n = sum(f.endswith(".gz") for f in files)
    return "" if not n else "GZIP" if n == len(files) else MIXED


def _store(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _opened(path: str):
    """A file to read from its start, unpacked if its first bytes say that it is gzip."""
    store, name = _store(path)
    source = store.open_input_file(name)
    packed = source.read(2) == b"\x1f\x8b"
    source.seek(0)
    return gzip.GzipFile(fileobj=source) if packed else source


def read_records(spark: SparkSession, paths: str | list[str], column: str = "record", verify: bool = True, with_file: bool = False) -> DataFrame:
    """The records of all files of some patterns, as one binary column; gzip is told by a file's first bytes."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("at least one pattern is needed")
    files = spark.read.format("binaryFile").load(paths).select("path")
    schema = T.StructType([*([T.StructField("file", T.StringType()), T.StructField("pos", T.LongType())] if with_file else []), T.StructField(column, T.BinaryType())])

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                at = 0
                with _opened(path) as source:
                    for part in wire.stream_records(source, verify):
                        cols = [pa.array(part, pa.binary())]
                        if with_file:
                            cols = [pa.array([path] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), *cols]
                        at += len(part)
                        yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return files.mapInArrow(run, schema)


def write_records(df: DataFrame, path: str, column: str = "record", compress: bool = False) -> int:
    """Record files part-*.rec in a folder, one for each partition with rows; gives the number of records written.

    The folder must be one that executors share. A task writes under a temporary name and renames at its end, so a
    task that is run again replaces its own file and leaves no half file under a final name.
    """

    def run(batches):
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, n, out = f"{root}/_part-{part:05d}-{uuid.uuid4().hex}.tmp", 0, None
        packer = zlib.compressobj(wbits=31) if compress else None
        for b in examples.pieces(batches):
            records = b.column(0).to_pylist()
            if records and out is None:
                out = store.open_output_stream(name)
            if records:
                data = wire.frame(records)
                out.write(packer.compress(data) if packer else data)
                n += len(records)
        if out is not None:
            if packer:
                out.write(packer.flush())
            out.close()
            store.move(name, f"{root}/part-{part:05d}.rec{'.gz' if compress else ''}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return int(df.select(column).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


class RecordSource:
    """A reader of raw records and a decoder. Both halves can be used alone, on one read if cached."""

    def __init__(self, read: Callable[[SparkSession], DataFrame], decode: Callable[[DataFrame], DataFrame], column: str = "record"):
        self._read, self._decode, self.column = read, decode, column

    def raw(self, spark: SparkSession) -> DataFrame:
        return self._read(spark)

    def decode(self, raw: DataFrame) -> DataFrame:
        return self._decode(raw)

    def load(self, spark: SparkSession) -> DataFrame:
        return self.decode(self.raw(spark))


def example_records(paths, schema: FeatureSchema | None = None, raw_record: str | None = None) -> RecordSource:
    """Files of example records."""
    return RecordSource(lambda s: read_records(s, paths), lambda df: examples.decode_examples(df, "record", schema, raw_record))


def sequence_records(paths, context: FeatureSchema | None = None, raw_record: str | None = None, sequence: str = examples.SEQUENCE) -> RecordSource:
    """S3: files of sequence-example records."""
    return RecordSource(lambda s: read_records(s, paths), lambda df: examples.decode_sequences(df, "record", context, None, sequence, raw_record))


def raw_records(paths, name: str = "raw_record") -> RecordSource:
    """Records undecoded, each a list of one."""
    return RecordSource(lambda s: read_records(s, paths), lambda df: raw_column(df, "record", name))


def raw_column(df: DataFrame, column: str, name: str = "raw_record") -> DataFrame:
    """The same of records at hand."""
    return df.select(F.array(column).alias(name))


def decoded_records(paths, decoder_path: str, raw_record: str | None = None) -> RecordSource:
    """Files of records and a saved decoder."""
    decoder = examples.load_decoder(decoder_path)
    return RecordSource(lambda s: read_records(s, paths), lambda df: examples.decode_with(df, "record", decoder, raw_record))
