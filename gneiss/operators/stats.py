"""M1-M5: merging shards of feature statistics, a keyed fold.

A shard table holds one row for each slice and feature of a shard:
(slice, num_examples, weighted_num_examples, feature_id, is_path, type, stats_kind, derived, payload.., custom). A name
and a path of the same text are different features. Merging checks what must agree and joins the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["slice", "feature_id", "is_path"]


def _agreed(c: str, zero, what: str) -> Column:
    """The one value other than zero, if there is none zero; two different ones are an error."""
    known = F.when(F.col(c).isNotNull() & (F.col(c) != zero), F.col(c))
    return F.when(F.min(known) != F.max(known), F.raise_error(F.concat(F.lit(f"shards disagree on {what}: "), F.min(known).cast("string"), F.lit(" and "), F.max(known).cast("string")))).otherwise(F.coalesce(F.max(known), F.lit(zero)))


def _field(name: str):
    return lambda x: x[name]


def folded(found: Column, kind: T.DataType) -> Column:
    """M3: one value out of a list of values of a type, as messages merge: repeated fields are joined in order, the fields of
    structs are folded one by one, of map entries and other values the last one that is set stays."""
    known = F.filter(found, lambda x: x.isNotNull())
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(known) > 0, F.flatten(known))
    if isinstance(kind, T.StructType):
        fields = [folded(F.transform(known, _field(f.name)), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(F.size(known) > 0, F.struct(*fields))
    if isinstance(kind, T.MapType):
        start = F.create_map().cast(kind)
        whole = F.aggregate(known, start, lambda a, x: F.map_zip_with(a, x, lambda _, old, new: F.coalesce(new, old)))
        return F.when(F.size(known) > 0, whole)
    return F.try_element_at(known, F.lit(-1))


def merge_statistics(shards: DataFrame, sums: list[str] = (), lists: list[str] = (), last: list[str] = (), order: str | None = None, payloads: list[str] = ()) -> DataFrame:
    """M1, M3: one row for each slice and feature.

    num_examples and weighted_num_examples must be equal or zero, type equal or INT, stats_kind equal or unset, derived
    equal. Columns in `lists` (arrays, custom among them) are joined in shard order, those in `last` are taken from the
    last shard that has them; those in `sums` are added up, for payloads that count. Columns in `payloads` are nested
    messages of any shape (histograms, custom statistics): they are folded by their type, see folded(), in shard order.
    """
    have = set(shards.columns)
    agg = [_agreed(c, z, what).alias(c) for c, z, what in (("num_examples", 0, "num_examples"), ("weighted_num_examples", 0.0, "weighted_num_examples"), ("type", "INT", "type"), ("stats_kind", "", "statistics kind")) if c in have]
    if "derived" in have:
        agg.append(F.when(F.count_distinct(F.coalesce("derived", F.lit(""))) > 1, F.raise_error(F.lit("shards disagree on derived source"))).otherwise(F.max("derived")).alias("derived"))
    at = F.col(order) if order else F.lit(0)
    agg += [F.sum(c).alias(c) for c in sums]
    agg += [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.col(c).alias("x")))), lambda s: F.coalesce(s["x"], F.array().cast(shards.schema[c].dataType)))).alias(c) for c in lists]
    agg += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last]
    before = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)  # noqa: E731  payloads may hold maps, which have no order
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.col(c).alias("x"))), before), lambda s: s["x"])
    agg += [folded(ordered(c), shards.schema[c].dataType).alias(c) for c in payloads]
    return shards.groupBy(*[k for k in KEY if k in have]).agg(*agg)


def merge_cross_statistics(shards: DataFrame, sums: list[str] = (), last: list[str] = (), order: str | None = None) -> DataFrame:
    """M4: one row for each slice and pair of features (path_x, path_y); counts equal or zero, kinds equal or unset."""
    at = F.col(order) if order else F.lit(0)
    agg = [_agreed("count", 0, "cross count").alias("count")]
    if "stats_kind" in shards.columns:
        agg.append(_agreed("stats_kind", "", "cross statistics kind").alias("stats_kind"))
    agg += [F.sum(c).alias(c) for c in sums] + [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last]
    return shards.groupBy("slice", "path_x", "path_y").agg(*agg)


def merge_lists(lists: DataFrame, column: str, **options) -> DataFrame:
    """M2: the same over rows that each hold a list of shards."""
    return merge_statistics(lists.select(F.explode(column).alias("s")).select("s.*"), **options)


class Accumulator:
    """M5: shards gathered one table at a time, merged once by get()."""

    def __init__(self, version: int = 0, empty_placeholder: bool = True):
        if version != 0:
            raise NotImplementedError("only version 0 is defined")
        self.placeholder, self.shards, self.done = empty_placeholder, None, False

    def merge(self, shards: DataFrame) -> None:
        if self.done:
            raise RuntimeError("the result has been taken")
        self.shards = shards if self.shards is None else self.shards.unionByName(shards)

    def get(self, spark, **options) -> DataFrame:
        """The merged table; without any shard row, one placeholder row of nulls if asked for."""
        if self.done:
            raise RuntimeError("the result has been taken")
        self.done = True
        if self.shards is None:
            schema = T.StructType([T.StructField("slice", T.StringType()), T.StructField("num_examples", T.LongType())])
            return spark.createDataFrame([(None, 0)] if self.placeholder else [], schema)
        out = merge_statistics(self.shards, **options)
        if not self.placeholder:
            return out
        nothing = spark.range(1).join(out.limit(1).select(F.lit(1).alias("_one")), how="left").where("_one is null")
        return out.unionByName(nothing.select("_one").drop("_one"), allowMissingColumns=True)


def column_statistics(df: DataFrame, columns: list[str], slice_by: Column | None = None) -> DataFrame:
    """Shard rows of numeric columns: (slice, num_examples, feature_id, is_path, type, stats_kind, n, n_missing, min, max, sum)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature_id"), F.col(c).cast("double").alias("v")) for c in columns]))
    rows = df.select((slice_by if slice_by is not None else F.lit("")).cast("string").alias("slice"), pairs.alias("x")).select("slice", "x.*")
    return rows.groupBy("slice", "feature_id").agg(
        F.count(F.lit(1)).alias("num_examples"), F.lit(False).alias("is_path"), F.lit("FLOAT").alias("type"), F.lit("num").alias("stats_kind"),
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"),
    )
