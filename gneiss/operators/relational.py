"""Projections, canonical forms, schema-merging unions, gathering and batching."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical types by the kind letter of numpy types.
KINDS = {"i": "bigint", "u": "decimal(20,0)", "f": "double", "b": "tinyint", "S": "binary", "O": "binary", "U": "binary"}


def kind_to_type(kind: str) -> str | None:
    """The canonical type of a numpy kind letter, or None."""
    return KINDS.get(kind)


def _kind(t: T.DataType) -> str | None:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "i"
    if isinstance(t, T.DecimalType) and t.scale == 0:
        return "u"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "f"
    if isinstance(t, T.BooleanType):
        return "b"
    return "S" if isinstance(t, (T.StringType, T.BinaryType)) else None


def canonical_type(t: T.DataType) -> str:
    """The canonical type of values or (nested) lists of values; TypeError for all others."""
    if isinstance(t, T.ArrayType):
        return f"array<{canonical_type(t.elementType)}>"
    if isinstance(t, T.NullType):
        return "void"
    if (k := _kind(t)) is None:
        raise TypeError(f"no canonical type for {t.simpleString()}")
    return KINDS[k]


def canonicalize(df: DataFrame) -> DataFrame:
    """P5: every column cast to its canonical type; values that are no lists become lists of one, nulls stay."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f.name).cast(canonical_type(f.dataType)), f.dataType
        out.append((c if isinstance(t, T.ArrayType) else F.when(c.isNotNull(), F.array(c))).alias(f.name))
    return df.select(*out)


def split_label(df: DataFrame, label: str) -> DataFrame:
    """(features, label): all other columns as one struct, and the label."""
    if label not in df.columns:
        raise KeyError(f"{label} is not a column")
    return df.select(F.struct(*[c for c in df.columns if c != label]).alias("features"), F.col(label).alias("label"))


def take(df: DataFrame, index: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose `index` column is asked for by wanted(pos, index), once for each asking, with pos.

    The join leaves the order free; sort by pos where it matters.
    """
    return wanted.select("pos", F.col(index).alias("_i")).join(df, F.col("_i") == F.col(index)).drop("_i")


def take_list(df: DataFrame, index: str, indices: list[int]) -> DataFrame:
    """P7 for a list of row numbers, duplicates kept."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), f"pos int, {index} long")
    return take(df, index, wanted)


def merged_type(a: T.DataType, b: T.DataType, at: str = "") -> T.DataType:
    """The one type that both merge into; null gives way, lists and structs merge inside, else TypeError."""
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType, f"{at}[]"))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys([*a.fieldNames(), *b.fieldNames()]))
        fields = []
        for n in names:
            kinds = [s[n].dataType for s in (a, b) if n in s.fieldNames()]
            fields.append(T.StructField(n, reduce(lambda x, y: merged_type(x, y, f"{at}.{n}"), kinds)))
        return T.StructType(fields)
    if type(a) is not type(b) or a != b:
        raise TypeError(f"{at.lstrip('.')}: {a.simpleString()} and {b.simpleString()} don't merge")
    return a


def _to(c: Column, have: T.DataType | None, want: T.DataType) -> Column:
    if have is None or isinstance(have, T.NullType):
        return F.lit(None).cast(want)
    if have == want or not isinstance(want, (T.ArrayType, T.StructType)):
        return c
    if isinstance(want, T.ArrayType):
        if isinstance(have.elementType, T.NullType):
            return c.cast(want)
        return F.transform(c, lambda x: _to(x, have.elementType, want.elementType))
    held = set(have.fieldNames())
    fields = [_to(c.getField(f.name) if f.name in held else F.lit(None), have[f.name].dataType if f.name in held else None, f.dataType).alias(f.name) for f in want.fields]
    return F.when(c.isNotNull(), F.struct(*fields))


def merge_batches(batches: list[DataFrame]) -> DataFrame:
    """All rows under the union of the schemas, columns in the order they are first seen; no shuffle."""
    if not batches:
        raise ValueError("nothing to merge")
    schema = reduce(merged_type, [b.schema for b in batches])
    aligned = [
        b.select(*[_to(F.col(f"`{f.name}`") if f.name in b.columns else F.lit(None), b.schema[f.name].dataType if f.name in b.columns else None, f.dataType).alias(f.name) for f in schema.fields])
        for b in batches
    ]
    return reduce(DataFrame.unionAll, aligned)


def flatten_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Union-all of sources of one schema."""
    return reduce(DataFrame.unionByName, frames)


BYTE_TARGET, MOST_ROWS = 20 << 20, 8192


def batch_settings(batch_size: int | None = None, by_bytes: bool = False) -> dict[str, str]:
    """Spark settings for batches that Python code sees: fixed rows, a byte target, or adaptive (1000 rows)."""
    if batch_size is not None:
        if batch_size < 1:
            raise ValueError("a batch holds one row at least")
        return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_size)}
    if by_bytes:
        return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(MOST_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BYTE_TARGET)}
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def batch_weight(size: Column) -> Column:
    """What an element counts towards the byte target: its size, but never less than the target by MOST_ROWS."""
    return F.greatest(size.cast("long"), F.lit(-(-BYTE_TARGET // MOST_ROWS)).cast("long"))


def range_bases(df: DataFrame, order: str, amount: Column, width: int = 0) -> DataFrame:
    """(_b, _base): for each range of 2**16 whole numbers that `order` falls in, the sum of amount over all smaller ranges.
    An amount may be a list of `width` numbers; then so is the sum.

    Sums go up a tree of ranges of 2**16, 2**32 and 2**48 numbers and come down again. A node has 2**16 children at most,
    so no window is larger, however sparse the numbers are; the top has no parent, and as few rows.
    """
    at = lambda bits: F.shiftright(F.col(order).cast("long"), bits)
    parts = [f"n{i}" for i in range(max(1, width))]
    rows = df.select(at(48).alias("_d"), at(32).alias("_c"), at(16).alias("_b"), *((F.get(amount, i) if width else amount).alias(n) for i, n in enumerate(parts)))
    sums = [F.sum(n).alias(n) for n in parts]
    one = rows.groupBy("_d", "_c", "_b").agg(*sums)
    two = one.groupBy("_d", "_c").agg(*sums)
    top = two.groupBy("_d").agg(*sums)

    def before(keys, child):
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(child).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"here_{n}") for n in parts]

    added = lambda: [(F.col(f"here_{n}") + F.col(f"base_{n}")).alias(f"base_{n}") for n in parts]
    top = top.select("_d", *before([], "_d")).withColumnsRenamed({f"here_{n}": f"base_{n}" for n in parts})
    two = two.select("_d", "_c", *before(["_d"], "_c")).join(F.broadcast(top), "_d").select("_d", "_c", *added())
    whole = one.select("_d", "_c", "_b", *before(["_d", "_c"], "_b")).join(two, ["_d", "_c"]).select("_b", *added())
    return whole.select("_b", (F.array(*(f"base_{n}" for n in parts)) if width else F.col("base_n0")).alias("_base"))


def batch_ids(df: DataFrame, order: str, size: int, bucket: Column | None = None) -> DataFrame:
    """Df with batch_id: consecutive rows by `order`, `size` to a batch.

    Rows are numbered without bringing them into one task, from sums over ranges of the order, which is a column of
    whole numbers. Other orders need `bucket`, a monotone function of them with few values; its values' counts are
    summed in one window.
    """
    if size < 1:
        raise ValueError("a batch holds one row at least")
    if bucket is None:
        df = df.withColumn("_b", F.shiftright(F.col(order).cast("long"), 16))
        first = range_bases(df, order, F.lit(1))
    else:
        df = df.withColumn("_b", bucket)
        counts = df.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        first = counts.select("_b", F.coalesce(upto, F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1 + F.col("_base")
    return df.join(first, "_b").withColumn("batch_id", F.floor(number / size).cast("long")).drop("_b", "_base")


def epoch_order(df: DataFrame, seed: int, epoch: int = 0, key: list[str] | None = None) -> list[Column]:
    """What to order rows by for an epoch: a hash of their key (all columns, if none is named), seed and epoch, then the key.

    It depends on the rows alone, so partitions, retries and machines don't change the order; rows that repeat a key are alike.
    """
    key = [F.col(f"`{c}`") for c in (key or df.columns)]
    return [F.xxhash64(F.lit(seed).cast("long"), F.lit(epoch).cast("long"), *key), *key]


def epoch_batches(
    df: DataFrame, batch_size: int, epochs: int = 1, seed: int | None = None, key: list[str] | None = None, drop_final: bool = False, first_batch: int = 0
) -> DataFrame:
    """Df with (epoch, position, batch_id): the rows of some epochs, each in a new order, cut into batches of batch_size.

    Epochs follow one another before they are cut, so a batch may reach from one into the next; the last one is short
    unless drop_final. Without a seed, epochs are ordered by the key as it is. Rows are numbered from sums over ranges of the
    hash, without bringing them into one task. Batches before first_batch are left out: given the same rows and seed, a job that was
    stopped goes on where it was.
    """
    if batch_size < 1:
        raise ValueError("a batch holds one row at least")
    n = df.count()
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else df.limit(0).withColumn("epoch", F.lit(0))
    columns = key or df.columns
    names = [F.col(f"`{c}`") for c in columns]
    if seed is None:
        if len(columns) > 1 or not isinstance(df.schema[columns[0]].dataType, T.IntegralType):
            raise ValueError("without a seed the key must be one column of whole numbers")
        each, rank = each.withColumn("_at", names[0].cast("long")), [F.col("_at")]
    else:
        hashed = F.xxhash64(F.lit(seed).cast("long"), F.col("epoch").cast("long"), *names)
        # few rows share a hash's upper bits, so ranges of them stay small however many rows there are
        each, rank = each.withColumn("_at", F.shiftright(hashed, 20)), [hashed, *names]
    counts = range_bases(each, "_at", F.transform(F.sequence(F.lit(0), F.lit(max(0, epochs - 1))), lambda e: (e == F.col("epoch")).cast("long")), max(1, epochs))
    inside = Window.partitionBy("_b", "epoch").orderBy(*rank)
    numbered = each.withColumn("_b", F.shiftright("_at", 16)).withColumn("_i", F.row_number().over(inside) - 1).join(counts, "_b")
    position = (F.get("_base", F.col("epoch")) + F.col("_i")).cast("long")
    out = numbered.withColumn("position", position).withColumn("batch_id", F.floor((F.col("epoch").cast("long") * n + F.col("position")) / batch_size).cast("long"))
    whole = n * epochs // batch_size
    out = out.where((F.col("batch_id") >= first_batch) & (F.col("batch_id") < whole)) if drop_final else out.where(F.col("batch_id") >= first_batch)
    return out.select(*(F.col(f"`{c}`") for c in df.columns), "epoch", "position", "batch_id")


def record_batches(
    df: DataFrame, batch_size: int, drop_final: bool = False, epochs: int | None = 1, shuffle: bool = False, seed: int | None = None, key: list[str] | None = None
) -> Iterator[list]:
    """Batches of rows for a local consumer, fetched partition by partition; epochs=None goes on for ever.

    Epochs follow one another before they are cut into batches. As long as it repeats for ever, the last short batch is
    dropped; shuffling draws a new order for each epoch, the same one for the same seed (see epoch_order()).
    """
    if shuffle and seed is None:
        seed = random.getrandbits(62)
    epoch, held = 0, []
    while epochs is None or epoch < epochs:
        rows = df.orderBy(*epoch_order(df, seed, epoch, key)) if shuffle else df
        for r in rows.toLocalIterator():
            held.append(r)
            if len(held) == batch_size:
                yield held
                held = []
        epoch += 1
        if epochs is None and epoch == 1 and not held and df.isEmpty():
            return
    if held and not drop_final:
        yield held


def labelled_batches(df: DataFrame, label: str | None, **options) -> Iterator:
    """Batches as in record_batches(), each row a (features, label) pair if a label is named."""
    if label is None:
        yield from record_batches(df, **options)
        return
    for batch in record_batches(split_label(df, label), **options):
        yield [(r["features"], r["label"]) for r in batch]
