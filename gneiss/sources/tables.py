"""Parquet, and datasets in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The files of some patterns; columns and filters reach the scan. Without a schema the first footer counts."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("at least one pattern is needed")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*paths)
    if columns is not None:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"no such column: {', '.join(missing)}")
        df = df.select(*columns)
    return df


def _leaf(c: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.ArrayType):
        return c.cast(T.ArrayType(_leaf_type(kind.elementType, name)))
    return c.cast(_leaf_type(kind, name))


def _leaf_type(kind: T.DataType, name: str) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_leaf_type(kind.elementType, name))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return T.FloatType()
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return T.LongType()
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return kind
    raise TypeError(f"{name}: datasets hold numbers and text, not {kind.simpleString()}")


def flatten_dataset(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Nested structs as columns outer_inner, floating as float, whole and boolean as bigint, text as it is."""
    out: list[tuple[str, Column]] = []

    def walk(prefix: str, c: Column, kind: T.DataType):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{prefix}_{f.name}" if prefix else f.name, c.getField(f.name), f.dataType)
        else:
            out.append((prefix, _leaf(c, kind, prefix)))

    for f in df.schema.fields:
        walk(f.name, F.col(f"`{f.name}`"), f.dataType)
    if names is not None and len(names) != len(out):
        raise ValueError(f"{len(out)} features, but {len(names)} names")
    return df.select(*[c.alias(n) for n, (_, c) in zip(names or [n for n, _ in out], out)])


def from_rows(spark: SparkSession, rows: list, schema=None, shards: int = 1) -> DataFrame:
    """A dataset in memory, dealt to shards; a row that is a tuple without names has features feature0, feature1, .."""
    if rows and schema is None and isinstance(rows[0], tuple) and not hasattr(rows[0], "_fields"):
        schema = [f"feature{i}" for i in range(len(rows[0]))]
    return flatten_dataset(spark.createDataFrame(rows, schema)).repartition(shards)
