"""List kernels: scalar functions over nested and ragged columns, and the row-shaped forms of those that change rows.

Functions that return a Column stay inside the JVM. Where an operator turns list elements into rows, it takes the name
of a column that identifies the source row: a DataFrame has no row positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = (T.StringType, T.BinaryType)


def is_list_like(kind: T.DataType) -> bool:
    """A10: whether a type is a list."""
    return isinstance(kind, T.ArrayType)


def innermost_type(kind: T.DataType) -> T.DataType:
    """A10: the type under all list levels."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


def depth(kind: T.DataType) -> int:
    """Number of list levels."""
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def element_lengths(df: DataFrame, column: str) -> Column:
    """A1: length of each list, or byte length of each string or binary; 0 for null."""
    kind = df.schema[column].dataType
    if is_list_like(kind):
        return F.coalesce(F.size(column), F.lit(0)).cast("long")
    if isinstance(kind, TEXT):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    raise TypeError(f"{column}: lengths need a list, string or binary column, not {kind.simpleString()}")


def parent_indices(df: DataFrame, column: str, row: str) -> DataFrame:
    """A2: one (row, pos) for each element of the lists; null and empty lists have none."""
    return df.select(F.col(row).alias("row"), F.posexplode(column).alias("pos", "value")).select("row", "pos")


def null_bitmap(column: str) -> Column:
    """A3: 1 where null, else 0."""
    return F.isnull(column).cast("byte")


def total_bytes(column: str) -> Column:
    """A4 (aggregate): bytes in all values."""
    return F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")


def regroup(flat: DataFrame, parents: DataFrame, parent: str, pos: str, value: str, empty_as_null: bool = True) -> DataFrame:
    """A5: lists of flat's values in order of pos, for every row of parents(parent); without values null or [].

    Both sides are dealt by parent once; values are collected within their parent, the size of one result list.
    """
    lists = flat.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))
    out = parents.join(lists, parent, "left")
    return out if empty_as_null else out.withColumn("values", F.coalesce("values", F.array()))


def regroup_range(flat: DataFrame, n: int, parent: str = "parent", pos: str = "pos", value: str = "value", empty_as_null: bool = True) -> DataFrame:
    """A5 over the dense parents 0..n-1; a parent outside of them is an error."""
    kind = flat.schema[parent].dataType
    if not isinstance(kind, T.LongType):
        raise TypeError(f"{parent} must be bigint, not {kind.simpleString()}")
    inside = (F.col(parent) >= 0) & (F.col(parent) < n)
    checked = flat.withColumn(parent, F.when(inside, F.col(parent)).otherwise(F.raise_error(F.format_string("parent %s is not in 0..%s", F.col(parent), F.lit(n - 1)))))
    return regroup(checked, flat.sparkSession.range(n).withColumnRenamed("id", parent), parent, pos, value, empty_as_null)


def coo(df: DataFrame, column: str, row: str) -> DataFrame:
    """(row, i0, .., value), the coordinates of every leaf of a nested list; null counts as empty."""
    levels = depth(df.schema[column].dataType)
    if not levels:
        raise TypeError(f"{column} is not a list")
    out = df.select(F.col(row).alias("row"), F.col(column).alias("value"))
    done = ["row"]
    for i in range(levels):
        out = out.select(*done, F.posexplode("value").alias(f"i{i}", "value"))
        done.append(f"i{i}")
    return out


def coo_shape(df: DataFrame, column: str) -> DataFrame:
    """One row with the dense shape [rows, longest list, longest inner list, ..]."""
    levels = depth(df.schema[column].dataType)
    sizes, inner = [], F.col(column)
    for i in range(levels):
        longest = inner
        if i == 0:
            sizes.append(F.coalesce(F.size(inner), F.lit(0)))
        else:
            sizes.append(F.coalesce(F.array_max(F.transform(longest, lambda x: F.coalesce(F.size(x), F.lit(0)))), F.lit(0)))
        if i + 1 < levels:
            inner = inner if i == 0 else F.flatten(F.filter(inner, lambda x: x.isNotNull()))
    return df.agg(F.array(F.count(F.lit(1)).cast("long"), *[F.coalesce(F.max(s), F.lit(0)).cast("long") for s in sizes]).alias("dense_shape"))


def fill_null_lists(df: DataFrame, column: str, fill: list) -> Column:
    """Null lists replaced by the given one."""
    kind = df.schema[column].dataType
    if not is_list_like(kind):
        raise TypeError(f"{column} is not a list")
    return F.coalesce(F.col(column), F.lit(fill).cast(kind) if fill else F.array().cast(kind))


def singleton(column) -> Column:
    """V becomes [v], null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNotNull(), F.array(c))


def flattened(df: DataFrame, column: str) -> Column:
    """The leaves under all list levels as one list; null lists on the way hold none."""
    c, kind = F.col(column), df.schema[column].dataType
    for _ in range(depth(kind) - 1):
        c = F.flatten(F.filter(c, lambda x: x.isNotNull()))
    return c


def flatten_nested(df: DataFrame, column: str, row: str) -> DataFrame:
    """(row, pos, value) of every leaf, in order; a column that is no list gives its own values."""
    if not is_list_like(df.schema[column].dataType):
        return df.select(F.col(row).alias("row"), F.lit(0).alias("pos"), F.col(column).alias("value"))
    return df.select(F.col(row).alias("row"), F.posexplode(flattened(df, column)).alias("pos", "value"))


def index_in(column, values: list) -> Column:
    """The first place of each value among the distinct values of a short list, null when absent.

    A null is found where the list holds one. Repeated values take no place of their own.
    """
    c = F.col(column) if isinstance(column, str) else column
    distinct = list(dict.fromkeys(values))
    found = F.lit(None).cast("long")
    if None in distinct:
        found = F.when(c.isNull(), F.lit(distinct.index(None)).cast("long"))
    rest = [(v, i) for i, v in enumerate(distinct) if v is not None]
    if not rest:
        return found
    table = F.lit([v for v, _ in rest])
    places = F.lit([i for _, i in rest]).cast("array<bigint>")
    return F.when(c.isNotNull(), F.get(places, (F.nullif(F.array_position(table, c), F.lit(0)) - 1).cast("int"))).otherwise(found)


def index_in_table(df: DataFrame, column: str, table: DataFrame, value: str = "value", index: str = "pos", small: int = 8 << 20) -> DataFrame:
    """A11 for a dictionary held in a table(value, index): df with `index_in`; null matches null.

    A dictionary of at most `small` bytes (summed here, rows with what a hash table takes for each) is broadcast; a
    larger one is joined by shuffling.
    """
    side = table.groupBy(F.col(value).alias("_v")).agg(F.min(index).cast("long").alias("index_in"))
    size = table.agg(F.sum(F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0)) + 40)).first()[0]
    if (size or 0) <= small:
        side = F.broadcast(side)
    return df.join(side, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


def invalid_utf8(column: str) -> Column:
    """A14 (aggregate): number of values that are not valid UTF-8; nulls don't count."""
    return F.count_if(F.col(column).isNotNull() & ~F.is_valid_utf8(F.col(column).cast("string"))).cast("long")


_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8}
OFFSET = 8


def byte_size(df: DataFrame, column: str) -> Column:
    """A12 (aggregate): logical columnar size in bytes.

    Fixed-width values count their width, booleans a bit each, text its bytes; lists and text add one OFFSET for each
    value and one more; every array whose column is nullable adds a validity bit for each value. A null-typed column
    is empty.
    """
    field = df.schema[column]
    return F.coalesce(_size(F.col(column), field.dataType, field.nullable, F.count(F.lit(1)), lambda e: F.sum(e)), F.lit(0)).cast("long")


def _size(c: Column, kind: T.DataType, nullable: bool, n: Column, total) -> Column:
    bitmap = F.ceil(n / 8) if nullable else F.lit(0)
    sums = lambda e: F.coalesce(total(e), F.lit(0))
    if isinstance(kind, T.NullType):
        return F.lit(0)
    if type(kind) in _WIDTH:
        return bitmap + n * _WIDTH[type(kind)]
    if isinstance(kind, T.BooleanType):
        return bitmap + F.ceil(n / 8)
    if isinstance(kind, TEXT):
        return bitmap + (n + 1) * OFFSET + sums(F.octet_length(c))
    if isinstance(kind, T.ArrayType):
        inner = sums(F.size(c))
        leaf = kind.elementType
        held = lambda e: total(_per_list(c, leaf, e))
        return bitmap + (n + 1) * OFFSET + _size_inner(c, leaf, kind.containsNull, inner, held)
    if isinstance(kind, T.StructType):
        return bitmap + sum((_size(c.getField(f.name), f.dataType, f.nullable, n, total) for f in kind.fields), F.lit(0))
    raise TypeError(f"byte size is not defined for {kind.simpleString()}")


def _per_list(c: Column, leaf: T.DataType, measure) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(measure(x).cast("long"), F.lit(0).cast("long")))


def _size_inner(c: Column, kind: T.DataType, nullable: bool, n: Column, held) -> Column:
    """Size of the array under one list level; held(f) sums f over all its values."""
    bitmap = F.ceil(n / 8) if nullable else F.lit(0)
    if isinstance(kind, T.NullType):
        return F.lit(0)
    if type(kind) in _WIDTH:
        return bitmap + n * _WIDTH[type(kind)]
    if isinstance(kind, T.BooleanType):
        return bitmap + F.ceil(n / 8)
    if isinstance(kind, TEXT):
        return bitmap + (n + 1) * OFFSET + F.coalesce(held(lambda x: F.octet_length(x)), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = F.coalesce(held(lambda x: F.size(x)), F.lit(0))
        leaf = kind.elementType
        return bitmap + (n + 1) * OFFSET + _size_inner(c, leaf, kind.containsNull, inner, lambda f: held(lambda x: _per_list(x, leaf, f)))
    if isinstance(kind, T.StructType):
        return bitmap + sum((_size_inner(c, f.dataType, f.nullable, n, _held_field(held, f.name)) for f in kind.fields), F.lit(0))
    raise TypeError(f"byte size is not defined for {kind.simpleString()}")


def _held_field(held, name: str):
    return lambda measure: held(lambda x: measure(x.getField(name)))


def total_byte_size(df: DataFrame, ignore_unsupported: bool = False) -> Column:
    """A13 (aggregate): sum of the columns' byte sizes; columns of other types are an error, or skipped."""
    out = F.lit(0).cast("long")
    for name in df.columns:
        try:
            out = out + byte_size(df, name)
        except TypeError:
            if not ignore_unsupported:
                raise
    return out
