"""Input profiles. Aggregates over a DataFrame, or observed while it passes by unchanged."""

from __future__ import annotations

import re
import time
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions import arrays
from gneiss.operators.paths import _struct


def metric_name(logical: str, physical: str, name: str) -> str:
    """L3: LogicalFormat[x]-PhysicalFormat[y]-name."""
    for part in (logical, physical):
        if re.search(r"[\[\]-]", part):
            raise ValueError(f"{part}: formats hold no brackets or dashes")
    return f"LogicalFormat[{logical}]-PhysicalFormat[{physical}]-{name}"


def namespace(*parts: str) -> str:
    """L4: a dotted namespace."""
    return ".".join(parts)


def value_kind(kind: T.DataType) -> str:
    """L1: INT, FLOAT, STRING, NULL or OTHER, by the innermost type."""
    leaf = arrays.innermost_type(kind)
    if isinstance(leaf, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(leaf, (T.FloatType, T.DoubleType)):
        return "FLOAT"
    if isinstance(leaf, (T.StringType, T.BinaryType)):
        return "STRING"
    return "NULL" if isinstance(leaf, T.NullType) else "OTHER"


def _distribution(e: Column) -> Column:
    e = e.cast("long")
    return F.struct(F.min(e).alias("min"), F.max(e).alias("max"), F.count(e).alias("count"), F.coalesce(F.sum(e), F.lit(0)).cast("long").alias("sum"))


def num_columns(df: DataFrame) -> Column:
    """L1a (aggregate): distribution of the number of non-null columns of a row."""
    return _distribution(sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0)))


def _leaves(c: Column, kind: T.DataType) -> list[tuple[str, Column]]:
    """(kind, number of values in a row) of each leaf below a column."""
    levels, struct = _struct(kind)
    if struct is None:
        if isinstance(kind, T.NullType):
            return [("NULL", F.lit(1))]
        if not isinstance(kind, T.ArrayType):
            return [(value_kind(kind), c.isNotNull().cast("int"))]
        return [(value_kind(kind), _count(c, kind))]
    out = []
    for f in struct.fields:
        inner = c if levels == 0 else _flat(c, levels)
        if levels == 0:
            out += _leaves(inner.getField(f.name), f.dataType)
        else:
            for k, _ in _leaves(F.lit(None).cast(f.dataType), f.dataType):
                out.append((k, F.aggregate(F.coalesce(inner, F.array().cast(T.ArrayType(struct))), F.lit(0), _adding(f))))
    return out


def _adding(f: T.StructField):
    return lambda total, x: total + F.coalesce(_count(x.getField(f.name), f.dataType), F.lit(0))


def _flat(c: Column, levels: int) -> Column:
    for _ in range(levels - 1):
        c = F.flatten(F.filter(c, lambda x: x.isNotNull()))
    return c


def _count(c: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.ArrayType):
        return c.isNotNull().cast("int")
    return F.coalesce(F.size(_flat(c, arrays.depth(kind))), F.lit(0))


def num_values(df: DataFrame) -> list[tuple[str, Column]]:
    """(kind, values in a row) of each leaf of each column."""
    return [x for f in df.schema.fields for x in _leaves(F.col(f.name), f.dataType)]


def value_distributions(df: DataFrame, fraction: float = 1.0, seed: int | None = None) -> DataFrame:
    """(kind, min, max, count, sum) of the values per row and leaf, by kind and over all (ALL); one pass.

    With a fraction below one, distributions are those of a sample of the rows, which is what they cost.
    """
    leaves = num_values(df)
    df = df if fraction >= 1 else df.sample(fraction, seed)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("long").alias("n")) for k, n in leaves]))
    both = F.explode(F.array(F.col("x.kind"), F.lit("ALL"))).alias("kind")
    return df.select(each.alias("x")).select(both, F.col("x.n").alias("n")).groupBy("kind").agg(
        F.min("n").alias("min"), F.max("n").alias("max"), F.count("n").alias("count"), F.sum("n").alias("sum")
    )


def num_cells(df: DataFrame) -> DataFrame:
    """(kind, cells): non-null cells of list columns by element kind; null-typed columns count every row."""
    sums: dict[str, Column] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NullType):
            k, n = "NULL", F.count(F.lit(1))
        else:
            k, n = value_kind(f.dataType), F.count(F.col(f.name))
        sums[k] = sums[k] + n if k in sums else n
    row = df.agg(F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("long").alias("cells")) for k, n in sums.items()]).alias("x"))
    return row.select(F.inline("x"))


def profile(df: DataFrame, logical: str = "table", physical: str = "parquet") -> DataFrame:
    """L1: (metric, min, max, count, sum) of a DataFrame: rows, bytes, columns and values, in one pass over the data."""
    leaves = num_values(df)
    parts = [("num_columns", num_columns(df))]
    for kind in [None, *dict.fromkeys(k for k, _ in leaves)]:
        mine = [n for k, n in leaves if kind in (None, k)]
        low, high = F.least(*mine, mine[0]), F.greatest(*mine, mine[0])
        d = F.struct(F.min(low).cast("long").alias("min"), F.max(high).cast("long").alias("max"), (F.count(F.lit(1)) * len(mine)).alias("count"), F.coalesce(F.sum(sum(mine, F.lit(0))), F.lit(0)).cast("long").alias("sum"))
        parts.append(("num_feature_values" + (f"[{kind}]" if kind else ""), d))
    whole = lambda n: F.struct(n.alias("min"), n.alias("max"), F.lit(1).cast("long").alias("count"), n.alias("sum"))
    parts += [("num_rows", whole(F.count(F.lit(1)).cast("long"))), ("record_batch_byte_size", whole(arrays.total_byte_size(df, ignore_unsupported=True)))]
    row = df.agg(F.array(*[F.struct(F.lit(metric_name(logical, physical, m)).alias("metric"), d.alias("d")) for m, d in parts]).alias("x"))
    return row.select(F.inline("x")).select("metric", "d.*")


def observed(df: DataFrame, name: str = "profile") -> tuple[DataFrame, Observation]:
    """L1 as a pass-through: df unchanged, and an observation with num_rows and num_columns once an action has run."""
    o = Observation(name)
    cells = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return df.observe(o, F.count(F.lit(1)).alias("num_rows"), F.min(cells).alias("columns_min"), F.max(cells).alias("columns_max"), F.sum(cells).alias("columns_sum")), o


def raw_records(df: DataFrame, column: str) -> DataFrame:
    """L2: (num_raw_records, min, max, count, sum) of the records' byte sizes."""
    return df.agg(F.count(F.lit(1)).alias("num_raw_records"), _distribution(F.octet_length(column)).alias("d")).select("num_raw_records", "d.*")


def tracked_bytes(df: DataFrame, ns: str, name: str) -> DataFrame:
    """(metric, bytes) of all columns."""
    return df.agg(arrays.total_byte_size(df, ignore_unsupported=True).alias("bytes")).select(F.lit(namespace(ns, name)).alias("metric"), "bytes")


def representation_counts(representations: dict) -> dict[str, int]:
    """How many tensor representations there are of each kind."""
    return dict(Counter(r.kind for r in representations.values()))


def batching(df: DataFrame, settings: dict[str, str], ns: str = "batching") -> DataFrame:
    """(metric, value): how batches are cut (see relational.batch_settings), and how many Spark's partitions make of df.

    A setting is one row; batches are counted in one pass, without Python.
    """
    rows = int(settings.get("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000))
    kept = [F.struct(F.lit(namespace(ns, k.rsplit(".", 1)[-1])).alias("metric"), F.lit(int(v)).cast("long").alias("value")) for k, v in sorted(settings.items())]
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    made = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.ceil(F.col("n") / rows)), F.lit(0)).cast("long").alias("b"))
    counted = [F.struct(F.lit(namespace(ns, "rows")).alias("metric"), F.col("n").alias("value")), F.struct(F.lit(namespace(ns, "batches")).alias("metric"), F.col("b").alias("value"))]
    return made.select(F.inline(F.array(*kept, *counted)))


class LoadTimer:
    """Seconds that a worker took to load what it needs, as (min, max, count, sum)."""

    def __init__(self):
        self.seconds: list[float] = []

    def __call__(self, load, *args):
        began = time.monotonic()
        out = load(*args)
        self.seconds.append(time.monotonic() - began)
        return out

    def distribution(self) -> tuple:
        s = self.seconds
        return (min(s), max(s), len(s), sum(s)) if s else (None, None, 0, 0.0)
