"""Columns to tensor-shaped columns, and back.

A tensor of a DataFrame keeps one part for each row: dense rows are flat lists of fixed length, sparse rows are
coordinates and values, ragged rows are nested lists. What spans rows (dense shapes, row splits) comes from aggregates.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions import arrays
from gneiss.operators.relational import range_bases
from gneiss.plans.features import Representation, check_default


def _path(r: Representation) -> Column:
    c = F.col(f"`{r.column[0]}`")
    for step in r.column[1:]:
        c = c.getField(step)
    return c


def dense(df: DataFrame, r: Representation) -> Column:
    """A row's list, which must hold as many values as the shape; a missing one is filled with the default."""
    kind = df.schema[r.column[0]].dataType
    if arrays.depth(kind) != 1:
        raise TypeError(f"{r.column[0]}: a dense tensor needs a plain list")
    n, c = prod(r.shape), _path(r)
    if r.default is not None:
        leaf = kind.elementType
        check_default(r.default, "BYTES" if isinstance(leaf, arrays.TEXT) else "FLOAT" if isinstance(leaf, (T.FloatType, T.DoubleType)) else "INT")
        c = F.coalesce(c, F.array_repeat(F.lit(r.default).cast(leaf), n))
    return F.when(F.coalesce(F.size(c), F.lit(0)) == n, c).otherwise(F.raise_error(F.lit(f"{r.column[0]}: a row has not {n} values")).cast(kind))


def varlen(df: DataFrame, r: Representation) -> Column:
    """(indices, values) of a row; null is empty."""
    c = F.coalesce(_path(r), F.array().cast(df.schema[r.column[0]].dataType))
    return F.struct(F.transform(c, lambda _, i: i.cast("long")).alias("indices"), c.alias("values"))


def sparse(df: DataFrame, r: Representation) -> Column:
    """(indices, values) of a row, each index a list of coordinates; index and value counts must agree."""
    for i in r.indices:
        kind = df.schema[i].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))):
            raise TypeError(f"{i}: index columns are lists of whole numbers")
    none = lambda c, n: F.coalesce(c, F.array().cast(df.schema[n].dataType))
    v = none(_path(r), r.column[0])
    idx = [none(F.col(f"`{i}`"), i) for i in r.indices]
    same = F.lit(True)
    for i in idx:
        same = same & (F.size(i) == F.size(v))
    rows = F.transform(v, lambda _, k: F.array(*[F.get(i, k).cast("long") for i in idx]))
    checked = F.when(same, rows).otherwise(F.raise_error(F.lit(f"{r.column[0]}: values and indices differ in number")).cast("array<array<bigint>>"))
    return F.struct(checked.alias("indices"), v.alias("values"))


def split_by_lengths(values: Column, lengths: Column, what: str = "row lengths") -> Column:
    """A list cut into lists of the given lengths, which must add up to its size."""
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    ends = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    lists = F.transform(F.arrays_zip(ends.alias("e"), lengths.alias("n")), lambda p: F.slice(values, (p["e"] - p["n"] + 1).cast("int"), p["n"].cast("int")))
    return F.when(total == F.size(values), lists).when(values.isNull() | lengths.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit(f"{what} don't add up to the number of values")))


def split_uniform(values: Column, n: int) -> Column:
    """A list cut into lists of n."""
    ok = F.size(values) % n == 0
    parts = F.when(F.size(values) == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), (F.size(values) / n).cast("int") - 1), lambda i: F.slice(values, i * n + 1, n)))
    return F.when(ok, parts).when(values.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit(f"the number of values is no multiple of {n}")))


def ragged(df: DataFrame, r: Representation) -> Column:
    """A row's nested list: as it is nested, then cut by its partitions, innermost last."""
    c = _path(r)
    for kind, arg in reversed(r.partitions):
        if kind == "uniform":
            c = split_uniform(c, arg)
        else:
            lengths = F.col(f"`{r.column[0]}`") if len(r.column) > 1 else F.col(f"`{arg}`")
            c = split_by_lengths(c, lengths.getField(arg) if len(r.column) > 1 else lengths)
    return c


def row_splits(df: DataFrame, column: str, order: str) -> DataFrame:
    """(order, split): where each row's values end in the flat value sequence; one row of 0 before the first.

    Sums come from ranges of the order, a column of whole numbers (see range_bases), so no task sees all rows.
    """
    n = F.coalesce(F.size(column), F.lit(0)).cast("long")
    rows = df.select(F.col(order).alias("order"), n.alias("n"), F.shiftright(F.col(order).cast("long"), 16).alias("_b"))
    inside = Window.partitionBy("_b").orderBy("order")
    return rows.join(range_bases(rows, "order", F.col("n")), "_b").select("order", (F.col("_base") + F.sum("n").over(inside)).cast("long").alias("split"))


def nested_row_splits(df: DataFrame, column: str | Column, order: str, uniform: int = 0) -> DataFrame:
    """(level, number, split) of a nested list column: where list `number` of a level ends among the elements of the
    next one, over all rows in order; a row of 0 before the first (number 0) is left out.

    The innermost `uniform` levels are of fixed size and have no splits: their elements are the inner shape. What a row adds
    to all levels is summed in one pass over ranges of the order (see range_bases); inside a row, lists are numbered by their place.
    A null list is an empty one.
    """
    values = F.col(column) if isinstance(column, str) else column
    flat = df.select(F.col(order).alias("_row"), values.alias("_v"))
    levels = arrays.depth(flat.schema["_v"].dataType) - uniform
    if levels < 1:
        raise TypeError("no ragged level is left")
    # sizes of the lists of each level, in order, and from them the numbers of elements of a row
    sizes, lists = [], F.array("_v")
    for i in range(levels):
        held = F.filter(lists, lambda x: x.isNotNull()) if i else lists
        sizes.append(F.transform(lists, lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")).alias(f"_s{i}"))
        lists = F.flatten(F.filter(held, lambda x: x.isNotNull()))
    sized = flat.select("_row", F.shiftright(F.col("_row").cast("long"), 16).alias("_b"), *sizes)
    total = lambda i: F.aggregate(f"_s{i}", F.lit(0).cast("long"), lambda a, x: a + x)
    sized = sized.select("_row", "_b", *(f"_s{i}" for i in range(levels)), *(total(i).alias(f"_n{i}") for i in range(levels)))
    amounts = [F.lit(1).cast("long"), *(F.col(f"_n{i}") for i in range(levels))]
    bases = range_bases(sized, "_row", F.array(*amounts), len(amounts))
    inside = Window.partitionBy("_b").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.get("_base", i)).alias(f"_a{i}") for i, a in enumerate(amounts)]
    placed = sized.join(bases, "_b").select("_row", *(f"_s{i}" for i in range(levels)), *before)
    each = F.array(*(F.struct(F.lit(i).alias("level"), F.col(f"_s{i}").alias("sizes"), F.col(f"_a{i}").alias("number"), F.col(f"_a{i + 1}").alias("start")) for i in range(levels)))
    rows = placed.select("_row", F.explode(each).alias("x")).select("_row", "x.*").select("_row", "level", "number", "start", F.posexplode("sizes").alias("i", "size"))
    upto = Window.partitionBy("_row", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("level", (F.col("number") + F.col("i") + 1).alias("number"), (F.col("start") + F.sum("size").over(upto)).alias("split"))


def ragged_splits(df: DataFrame, r: Representation, order: str) -> tuple[DataFrame, list[int]]:
    """nested_row_splits() of a representation, and the inner shape that its innermost uniform partitions give."""
    inner = []
    for kind, arg in reversed(r.partitions):
        if kind != "uniform":
            break
        inner.insert(0, arg)
    return nested_row_splits(df, ragged(df, r), order, len(inner)), inner


def to_tensor(df: DataFrame, name: str, r: Representation) -> Column:
    """The column of one tensor; what goes wrong names the tensor."""
    try:
        return {"dense": dense, "varlen": varlen, "sparse": sparse, "ragged": ragged}[r.kind](df, r).alias(name)
    except (TypeError, KeyError, ValueError) as e:
        raise type(e)(f"tensor {name}: {e}") from e


class TensorAdapter:
    """Representations over a schema; a projection remembers what it was taken from."""

    def __init__(self, schema: T.StructType, representations: dict[str, Representation], original: dict | None = None):
        self.schema, self.representations = schema, dict(representations)
        self.original = dict(original or representations)
        if not set(self.representations) <= set(self.original):
            raise ValueError("a projection has tensors that its origin has not")

    def type_specs(self) -> dict[str, tuple]:
        """(kind, static shape; -1 where rows differ) of each tensor."""
        return {n: (r.kind, _shape(r)) for n, r in self.representations.items()}

    def original_type_specs(self) -> dict[str, tuple]:
        return {n: (r.kind, _shape(r)) for n, r in self.original.items()}

    def to_tensors(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        names = {f.name: f.dataType for f in self.schema.fields}
        if {f.name: f.dataType for f in df.schema.fields} != names:
            raise ValueError("the rows don't have the adapter's schema")
        return df.select(*keep, *[to_tensor(df, n, r) for n, r in self.representations.items()])


def _shape(r: Representation) -> tuple:
    if r.kind == "dense":
        return (-1, *r.shape)
    if r.kind == "sparse":
        return (-1, *r.sizes)
    return (-1, -1, *[a for k, a in r.partitions if k == "uniform"])


def sparse_shape(df: DataFrame, tensor: str) -> DataFrame:
    """dense_shape [rows, longest] of a varlen tensor column."""
    return df.agg(F.array(F.count(F.lit(1)).cast("long"), F.coalesce(F.max(F.size(F.col(tensor)["values"])), F.lit(0)).cast("long")).alias("dense_shape"))


def sparse_rows(df: DataFrame, name: str, row: str, rank: int) -> DataFrame:
    """(row, i0, .., value): the coordinates of a sparse tensor column as rows."""
    z = F.arrays_zip(F.col(name)["indices"].alias("i"), F.col(name)["values"].alias("v"))
    return df.select(F.col(row).alias("row"), F.explode(z).alias("x")).select("row", *[F.get(F.col("x.i"), k).alias(f"i{k}") for k in range(rank)], F.col("x.v").alias("value"))


def from_dense(c: Column, shape: tuple[int, ...]) -> Column:
    """A nested row of a dense tensor as a flat list."""
    for _ in range(len(shape) - 1):
        c = F.flatten(c)
    return c


def from_sparse(coordinates: DataFrame, rows: DataFrame, row: str = "row", name: str = "value") -> DataFrame:
    """(row, name): lists of a 2-D sparse tensor's values (row, i0, value) by row; rows without any are empty."""
    return arrays.regroup(coordinates, rows, row, "i0", "value", empty_as_null=False).withColumnRenamed("values", name)


def _coordinate(k: int):
    return lambda s: s[f"i{k}"].cast("long")


def from_sparse_nd(coordinates: DataFrame, rows: DataFrame, name: str, rank: int) -> DataFrame:
    """Three and more dimensions: (row, name$values, name$index0, ..), values in the order of their indices."""
    at = [f"i{k}" for k in range(rank)]
    lists = coordinates.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*at, "value"))).alias("x"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kind = coordinates.schema["value"].dataType.simpleString()
    return rows.join(lists, "row", "left").select(
        "row",
        empty(F.transform("x", lambda s: s["value"]), f"array<{kind}>").alias(f"{name}$values"),
        *[empty(F.transform("x", _coordinate(k)), "array<bigint>").alias(f"{name}$index{k}") for k in range(rank)],
    )


def check_output_types(df: DataFrame, tensors: list[str]) -> None:
    """Booleans are no tensor values, and made names must be new."""
    made: list[str] = []
    for t in tensors:
        if isinstance(arrays.innermost_type(df.schema[t].dataType), T.BooleanType):
            raise TypeError(f"{t}: boolean tensors are not converted")
        made.append(t)
    if len(set(made)) != len(made):
        raise ValueError("two tensors make the same column")


def records_to_columns(df: DataFrame, tensors: list[str]) -> DataFrame:
    """Tensor columns as plain columns, sorted by name."""
    check_output_types(df, tensors)
    out = []
    for t in sorted(tensors):
        kind = df.schema[t].dataType
        out.append(F.col(t)["values"].alias(t) if isinstance(kind, T.StructType) else F.col(t))
    return df.select(*out)
