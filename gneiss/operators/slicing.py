"""Slices of examples and predicates over statistics."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slices_sql(df: DataFrame, row: str, statement: str) -> DataFrame:
    """Q1: for each row of df the slices that `SELECT STRUCT(..) [FROM example.f, ..] [WHERE ..]` makes of it.

    (row, slices): a list of slices, each a list of (key, value) text pairs; rows without a slice have an empty list.
    `FROM example.f` un-nests a repeated feature under its own name. The statement is Spark SQL over one row named
    example; what it un-nests stays inside the row, as nested list functions, so nothing is shuffled and rows need no
    key: null and repeated ids keep the slices of their own rows.
    """
    m = re.fullmatch(r"\s*SELECT\s+STRUCT\s*\((?P<s>.*?)\)\s*(?:FROM\s+(?P<f>.*?))?\s*(?:WHERE\s+(?P<w>.*?))?\s*;?\s*", statement, re.I | re.S)
    if not m:
        raise ValueError("a slice statement reads SELECT STRUCT(..) [FROM example.f, ..] [WHERE ..]")
    names = []
    for source in filter(None, (x.strip() for x in (m["f"] or "").split(","))):
        f = re.fullmatch(r"example\.(\w+)(?:\s+(?:AS\s+)?(\w+))?", source, re.I)
        if not f:
            raise ValueError(f"{source}: only features of example can be un-nested")
        names.append((f[1], f[2] or f[1]))
    slices = f"if(coalesce({m['w'] or 'true'}, false), array(struct({m['s']})), array())"
    for feature, name in reversed(names):
        slices = f"flatten(transform(coalesce(example.{feature}, array()), {name} -> {slices}))"
    made = df.select(F.col(row).alias("row"), F.struct(*[c for c in df.columns if c != row]).alias("example")).select("row", F.expr(slices).alias("s"))
    keys = made.schema["s"].dataType.elementType.fieldNames()
    pairs = lambda s: F.array(*[F.struct(F.lit(k).alias("key"), s.getField(k).cast("string").alias("value")) for k in keys])
    return made.select("row", F.array_sort(F.transform("s", pairs)).alias("slices"))


def _values(df: DataFrame, key: str) -> Column:
    c, kind = F.col(key), df.schema[key].dataType
    one = c if isinstance(kind, T.ArrayType) else F.array(c)
    return F.filter(F.transform(one, lambda x: x.cast("string")), lambda x: x.isNotNull())


def _equals(v: str):
    return lambda x: (x == v) | F.coalesce(x.try_cast("double") == F.lit(v).try_cast("double"), F.lit(False))


def slice_rows(df: DataFrame, keys: list[str] = (), values: dict[str, str] | None = None) -> DataFrame:
    """Df with slice_key, a list of (key, value) pairs: a row for each slice that an example is in.

    Keys take every value of the feature, crossed; fixed values filter. A number compares with a fixed value as text
    and as a number. Without keys and values every example is in the one overall slice.
    """
    out, pairs = df, []
    for i, k in enumerate(keys):
        out = out.withColumn(f"_k{i}", F.explode(F.array_distinct(_values(df, k))))
        pairs.append(F.struct(F.lit(k).alias("key"), F.col(f"_k{i}").alias("value")))
    for k, v in (values or {}).items():
        out = out.where(F.exists(_values(df, k), _equals(v)))
        pairs.append(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return out.withColumn("slice_key", F.array(*pairs) if pairs else empty).drop(*[f"_k{i}" for i in range(len(keys))])


def slice_counts(df: DataFrame, specs: list[tuple[list[str], dict[str, str]]], aggregates: dict[str, Column] | None = None) -> DataFrame:
    """(slice, n, ..) of each slice of some specifications; slice is its pairs as key:value, comma-joined."""
    parts = None
    for keys, values in specs:
        rows = slice_rows(df, keys, values)
        name = F.array_join(F.transform("slice_key", lambda p: F.concat(p["key"], F.lit(":"), p["value"])), ",")
        part = rows.withColumn("slice", name).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), *[c.alias(a) for a, c in (aggregates or {}).items()])
        parts = part if parts is None else parts.unionAll(part)
    return parts


def overall(df: DataFrame) -> DataFrame:
    """The specification of the overall slice alone."""
    return slice_counts(df, [([], {})])


def unary_predicate(stats: DataFrame, query: str) -> DataFrame:
    """Q2: the rows of a statistics table for which a boolean SQL expression over `feature` holds."""
    return stats.select(F.struct("*").alias("feature")).where(F.expr(query)).select("feature.*")


def binary_predicate(base: DataFrame, test: DataFrame, keys: list[str], query: str) -> DataFrame:
    """Q2: pairs of statistics rows of equal keys for which an expression over feature_base and feature_test holds."""
    a = base.select(*keys, F.struct("*").alias("feature_base"))
    return a.join(test.select(*keys, F.struct("*").alias("feature_test")), keys).where(F.expr(query))


def all_slices(df: DataFrame, keys: list[str]) -> list[tuple[list[str], dict]]:
    """Specifications of every subset of the keys."""
    return [([k for k, on in zip(keys, bits) if on], {}) for bits in product([0, 1], repeat=len(keys))]
