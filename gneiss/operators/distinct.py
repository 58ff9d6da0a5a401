"""G1: distinct counts, exact, by theta sketches, and by k minimum values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"INT": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "FLOAT": (T.FloatType, T.DoubleType), "TEXT": (T.StringType, T.BinaryType)}


def input_kind(kind: T.DataType) -> str:
    """The kind of values that a sketch takes; booleans, lists and others are an error."""
    for name, types in _KINDS.items():
        if isinstance(kind, types):
            return name
    raise TypeError(f"sketches don't take {kind.simpleString()}")


def distinct_exact(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Exact number of distinct non-null values."""
    input_kind(df.schema[column].dataType)
    return df.groupBy(*by).agg(F.count_distinct(column).cast("long").alias("n_distinct"))


def _log_k(k: int) -> int:
    if k < 1:
        raise ValueError("a sketch needs one bucket at least")
    return min(26, max(4, math.ceil(math.log2(k))))


def theta_sketch(df: DataFrame, column: str, k: int = 4096, by: list[str] = ()) -> DataFrame:
    """Mergeable sketches of k buckets (rounded up to a power of two), built map-side; exact below k."""
    input_kind(df.schema[column].dataType)
    return df.groupBy(*by).agg(F.theta_sketch_agg(column, F.lit(_log_k(k))).alias("sketch"))


def theta_merge(sketches: DataFrame, k: int = 4096, by: list[str] = ()) -> DataFrame:
    """Union of sketches."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", F.lit(_log_k(k))).alias("sketch"))


def theta_estimate(sketch: str = "sketch") -> Column:
    return F.theta_sketch_estimate(sketch)


def kmv(df: DataFrame, column: str, k: int = 128, by: list[str] = ()) -> DataFrame:
    """(by.., hashes): per group the k smallest distinct 64-bit hashes, a mergeable sketch of at most k numbers.

    Values hash by type: a float and a double of one number are different, text and binary of the same bytes alike.
    Two rounds of limits, first within hash-dealt parts of a group, then over the parts' k smallest, so neither a group
    nor its distinct values ever meet in one task; the limits act before each shuffle, too.
    """
    if k < 1:
        raise ValueError("a sketch needs one bucket at least")
    kind = input_kind(df.schema[column].dataType)
    value = F.col(column).cast("binary") if kind == "TEXT" else F.col(column)
    # hash order as unsigned: flip the sign bit
    h = F.xxhash64(value, F.lit(kind if kind != "FLOAT" else type(df.schema[column].dataType).__name__))
    rows = df.where(F.col(column).isNotNull()).select(*by, h.bitwiseXOR(F.lit(-(2**63))).alias("h"))
    part = F.pmod("h", F.lit(64)).alias("part")
    first = rows.select(*by, "h", part).withColumn("r", F.dense_rank().over(Window.partitionBy(*by, "part").orderBy("h")))
    first = first.where(F.col("r") <= k).select(*by, "h").distinct()
    whole = Window.partitionBy(*by).orderBy("h") if by else Window.partitionBy(F.lit(0)).orderBy("h")
    small = first.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k)
    return small.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("hashes"))


def kmv_merge(sketches: DataFrame, k: int = 128, by: list[str] = ()) -> DataFrame:
    """Sketches of one k (see kmv) merged: their hashes once each, of which the k smallest stay; limits act before shuffles."""
    each = sketches.select(*by, F.explode("hashes").alias("h")).distinct()
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("h")
    small = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return small.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("hashes"))


def kmv_estimate(k: int = 128, hashes: str = "hashes") -> Column:
    """The exact count below k hashes, else (k - 1) * 2**64 / (the k-th smallest), rounded."""
    kth = F.element_at(hashes, k).cast("double") + F.lit(2.0**63)
    return F.when(F.size(hashes) < k, F.size(hashes)).otherwise(F.round(F.lit((k - 1) * 2.0**64) / kth)).cast("long")
