"""Weighted quantiles, exact at any size, and approximate twins.

Boundary r of n is the smallest value whose cumulative weight is above r * W / n, or the largest value if none is;
the weight reported with it is its cumulative weight. Nulls, NaN and weights that are null, NaN, zero or negative are
left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sketches import Ranks, merged_ranks, rank_sketches

SIDE = 8  # a group is dealt to SIDE * SIDE ranges
SALTS = 64  # in how many places sketches of one group meet first


def _clean(df: DataFrame, value: str, weight: str | None, by: list[str]) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, F.col(value).cast("double").alias("v"), w.alias("w"))
    return rows.where("v is not null and not isnan(v) and w is not null and not isnan(w) and w > 0")


def cumulative(df: DataFrame, value: str, weight: str | None = None, by: list[str] = (), side: int = SIDE) -> DataFrame:
    """(by.., v, cw, before, tw, last): each distinct value with its cumulative weight and the one before it.

    Weights are first summed by value, before the shuffle. Values are then dealt to ranges by approximate quantiles of
    their group (side * side of them), summed up within each range, and shifted by the sums of the ranges below. So a
    group that holds all rows is spread over as many tasks; only the ranges' sums, a row each, are brought together.
    """
    by = list(by)
    g = _clean(df, value, weight, by).groupBy(*by, "v").agg(F.sum("w").alias("w"))
    cuts = [i / side**2 for i in range(1, side**2)]
    bounds = g.groupBy(*by).agg(F.percentile_approx("v", cuts, 1000).alias("cuts"))
    ranged = g.join(bounds, by) if by else g.crossJoin(F.broadcast(bounds))  # without keys: one row
    # the number of cuts below a value, found in two steps of side - 1 comparisons
    one = lambda c: F.coalesce((c < F.col("v")).cast("int"), F.lit(0))  # noqa: E731  never null: no filter is made of it
    below = lambda at: sum((one(F.get("cuts", at(j))) for j in range(side - 1)), F.lit(0))
    ranged = ranged.withColumn("block", below(lambda j: F.lit(side * j + side - 1)) * side)
    ranged = ranged.withColumn("part", F.col("block") + below(lambda j: F.col("block") + j)).drop("cuts", "block")
    sums = ranged.groupBy(*by, "part").agg(F.sum("w").alias("pw"), F.max("v").alias("top"))
    keys = by or [F.lit(0)]
    over = Window.partitionBy(*keys).orderBy("part")
    sums = (
        sums.withColumn("base", F.coalesce(F.sum("pw").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("tw", F.sum("pw").over(Window.partitionBy(*keys)))
        .withColumn("top", F.max("top").over(Window.partitionBy(*keys)))
        .drop("pw")
    )
    inside = Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        # dealt by range for the window anyway; left to itself, a broadcast may take the side of the values
        ranged.repartition(*by, "part").join(sums.hint("merge"), [*by, "part"])
        .withColumn("cw", F.col("base") + F.sum("w").over(inside))
        .withColumn("before", F.col("cw") - F.col("w"))
        .withColumn("last", F.col("v") == F.col("top"))
        .select(*by, "v", "cw", "before", "tw", "last")
    )


def quantiles(df: DataFrame, value: str, n: int, weight: str | None = None, by: list[str] = (), side: int = SIDE) -> DataFrame:
    """(by.., r, quantile, cum_weight) for r = 0..n; groups without values have no rows.

    Each value finds the boundaries that it is by itself: those r for which r * W / n lies in [before, cw).
    """
    if n < 2:
        raise ValueError("at least two quantiles are asked for")
    c = cumulative(df, value, weight, by, side)
    at = lambda r: r * F.col("tw") / F.lit(n)
    low = F.greatest(F.lit(0), F.floor(F.col("before") * n / F.col("tw")).cast("int") - 1)
    high = F.when(F.col("last"), F.lit(n)).otherwise(F.least(F.lit(n), F.ceil(F.col("cw") * n / F.col("tw")).cast("int") + 1))
    r = F.col("r")
    mine = (F.col("cw") > at(r)) | F.col("last")
    unclaimed = (F.col("before") <= at(r)) | (r == 0) & (F.col("before") == 0)
    return (
        c.withColumn("r", F.explode(F.sequence(low, high)))
        .where(mine & unclaimed)
        .select(*by, F.col("r").cast("long").alias("r"), F.col("v").alias("quantile"), F.col("cw").alias("cum_weight"))
    )


def boundaries(df: DataFrame, value: str, n: int, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by.., quantiles): the n + 1 boundaries as one list, smallest and largest value included."""
    q = quantiles(df, value, n, weight, by)
    return q.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "quantile"))), lambda x: x["quantile"]).alias("quantiles"))


def streams(df: DataFrame, values: list[str], n: int, weight: str | None = None) -> DataFrame:
    """G3 over several columns that share weights: (stream, r, quantile, cum_weight); one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("stream"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)]))
    rows = df.select(pairs.alias("x"), *([F.col(weight).alias("w")] if weight else [])).select("x.stream", "x.v", *(["w"] if weight else []))
    return quantiles(rows, "v", n, "w" if weight else None, ["stream"])


def approximate(df: DataFrame, value: str, n: int, eps: float = 0.01, by: list[str] = ()) -> DataFrame:
    """G3/G4, approximate and unweighted: (by.., quantiles) within eps of the rank, from mergeable partial summaries.

    A third of eps is given to each of the levels at which summaries merge, and it is bounded below.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    accuracy = min(1_000_000, max(1, round(3 / eps)))
    rows = _clean(df, value, None, list(by))
    return rows.groupBy(*by).agg(F.percentile_approx("v", [i / n for i in range(n + 1)], accuracy).alias("quantiles"))


def kll(df: DataFrame, value: str, k: int = 200, by: list[str] = ()) -> DataFrame:
    """(by.., sketch): a serialised mergeable quantile sketch of each group."""
    return _clean(df, value, None, list(by)).groupBy(*by).agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def kll_merge(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sketches of a group merged, before the shuffle and after it."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def _keys(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema) if by else ""


def _merged(sketches: DataFrame, by: list[str], salt: list[str]) -> DataFrame:
    """(by.., salt.., sketch): one sketch for each key. Rows of a key come to a task one after the other."""
    keys = [*by, *salt]
    worst = F.desc(F.substring("sketch", 5, 8))  # the error that stands in a sketch's head
    dealt = (sketches.repartition(*keys) if keys else sketches.repartition(1)).sortWithinPartitions(*keys, worst)
    return dealt.select(*keys, "sketch").mapInArrow(merged_ranks(keys), f"{_keys(sketches, keys)}sketch binary")


def sketch(df: DataFrame, value: str, eps: float, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by.., sketch): a serialised weighted quantile sketch of each group, ranks within eps of its weight.

    Tasks keep levels of weighted summaries by group while rows stream by, and only these leave them: values are never
    shuffled, and a task's state depends on eps. A group's sketches are merged in two steps, so that one key over all
    tasks doesn't meet in one. Half of eps is left for later merges.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    by = list(by)
    rows = _clean(df, value, weight, by).withColumnsRenamed({"v": "_value", "w": "_weight"})
    parts = rows.mapInArrow(rank_sketches(by, float(eps)), f"{_keys(rows, by)}sketch binary")
    return sketch_merge(parts, by)


def stream_sketches(df: DataFrame, values: list[str], eps: float, weight: str | None = None) -> DataFrame:
    """G3 over several columns that share weights: (stream, sketch); one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("stream"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)]))
    rows = df.select(pairs.alias("x"), *([F.col(weight).alias("w")] if weight else [])).select("x.stream", "x.v", *(["w"] if weight else []))
    return sketch(rows, "v", eps, "w" if weight else None, ["stream"])


def sketch_merge(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sketches of a group merged, within the eps that they were made with, however often that is done."""
    by = list(by)
    salted = sketches.select(*by, "sketch", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"))
    return _merged(_merged(salted, by, ["_salt"]), by, [])


def sketch_compact(sketches: DataFrame, eps: float, by: list[str] = ()) -> DataFrame:
    """Sketches cut back as far as ranks within eps of the weight allow; never needed for right results."""
    by = list(by)

    def run(batches):
        for batch in batches:
            cut = [None if x is None else Ranks.from_bytes(x)[0].fit(eps).to_bytes(eps) for x in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in by), pa.array(cut, pa.binary())], [*by, "sketch"])

    return sketches.select(*by, "sketch").mapInArrow(run, f"{_keys(sketches, by)}sketch binary")


def sketch_quantiles(sketches: DataFrame, n: int, by: list[str] = ()) -> DataFrame:
    """(by.., r, quantile, cum_weight) for r = 0..n of sketches, one for each group; ranks are within eps of the weight."""
    if n < 2:
        raise ValueError("at least two quantiles are asked for")
    by = list(by)

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column("sketch")):
                ranks = Ranks.from_bytes(data.as_py())[0] if data.is_valid else ()
                if len(ranks):
                    q, w = ranks.quantiles(n)
                    key = batch.slice(i, 1).take(pa.array(np.zeros(n + 1, np.int64)))
                    yield pa.RecordBatch.from_arrays([*(key.column(c) for c in by), pa.array(np.arange(n + 1)), pa.array(q), pa.array(w)], [*by, "r", "quantile", "cum_weight"])

    return sketches.select(*by, "sketch").mapInArrow(run, f"{_keys(sketches, by)}r long, quantile double, cum_weight double")
