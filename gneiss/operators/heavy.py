"""Heavy hitters, exact and by mergeable Misra-Gries summaries, with weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sketches import counter_rows


def clean_text(column: str, invalid: str = "__INVALID__", threshold: int | None = None, large: str = "__LARGE__") -> Column:
    """Invalid UTF-8 becomes one placeholder; else text of more than `threshold` bytes another."""
    c = F.col(column)
    out = F.when(c.isNull(), F.lit(None)).when(~F.is_valid_utf8(c.cast("string")), F.lit(invalid))
    if threshold is not None:
        out = out.when(F.octet_length(c) > threshold, F.lit(large))
    return out.otherwise(c.cast("string"))


def top_k(df: DataFrame, column: str | Column, k: int, weight: str | None = None, by: list[str] = (), reverse_ties: bool = False) -> DataFrame:
    """(by.., value, count): the k values of largest count or weight sum; ties by value, ascending or descending.

    Counts are combined before the shuffle, and the limit by group acts before the second one. Nulls don't count;
    weights that are null, NaN or negative are none.
    """
    c = F.col(column) if isinstance(column, str) else column
    rows = df.select(*by, c.alias("value"), *([F.col(weight).cast("double").alias("w")] if weight else [])).where("value is not null")
    if weight:
        n = F.sum(F.when(F.col("w").isNotNull() & ~F.isnan("w") & (F.col("w") > 0), F.col("w")).otherwise(0.0))
    else:
        n = F.count(F.lit(1)).cast("double")
    counts = rows.groupBy(*by, "value").agg(n.alias("count"))
    ties = F.desc("value") if reverse_ties else F.asc("value")
    if not by:
        return counts.orderBy(F.desc("count"), ties).limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("count"), ties)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


class MisraGries:
    """A summary of at most k counters; value counts are at most `delta` too low."""

    def __init__(self, k: int, counts: dict | None = None, delta: float = 0.0):
        if k < 1:
            raise ValueError("a sketch needs one bucket at least")
        self.k, self.counts, self.delta = k, dict(counts or {}), delta

    def add(self, values: pd.Series, weights: pd.Series | None = None) -> "MisraGries":
        """A batch, summed by value first; the counters are cut back once for the whole batch."""
        w = pd.Series(1.0, values.index) if weights is None else weights.astype(float)
        ok = values.notna() & w.notna() & (w > 0)
        for v, n in w[ok].groupby(values[ok]).sum().items():
            self.counts[v] = self.counts.get(v, 0.0) + n
        return self._cut()

    def merge(self, other: "MisraGries") -> "MisraGries":
        if other.k != self.k:
            raise ValueError("sketches of different sizes don't merge")
        for v, n in other.counts.items():
            self.counts[v] = self.counts.get(v, 0.0) + n
        self.delta += other.delta
        return self._cut()

    def _cut(self) -> "MisraGries":
        if len(self.counts) > self.k:
            rows = sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))
            least = rows[self.k][1]
            self.counts = {v: n - least for v, n in rows[: self.k]}
            self.delta += least
        return self

    def estimate(self, reverse_ties: bool = False) -> list[tuple]:
        """(value, upper bound of its count), largest first."""
        rows = sorted(self.counts.items(), key=lambda x: x[0], reverse=reverse_ties)
        return [(v, n + self.delta) for v, n in sorted(rows, key=lambda x: -x[1])]


def misra_gries(df: DataFrame, column: str, k: int, weight: str | None = None) -> DataFrame:
    """(value, count, delta): approximate top k over all rows. count is an upper bound, too high by delta at most.

    Every partition is reduced to k counters as it streams by; counters of one value are then summed by a combined
    shuffle, and the summary over all is cut back by its (k + 1)-th largest counter, of which only the first k + 1 are
    ever gathered. delta is at most the weight that is not kept, divided by k + 1, at each of both levels.
    """
    kind = df.schema[column].dataType.simpleString()
    rows = df.select(F.col(column).alias("value"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def part(frames):
        m = MisraGries(k)
        for f in frames:
            m.add(f["value"], f["w"])
        out = list(m.counts.items())
        yield pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype=object), "count": [n for _, n in out], "delta": 0.0})
        yield pd.DataFrame({"value": pd.Series([None], dtype=object), "count": [0.0], "delta": [m.delta]})

    parts = rows.mapInPandas(part, f"value {kind}, count double, delta double")
    sums = parts.groupBy("value").agg(F.sum("count").alias("count"), F.sum("delta").alias("delta"))
    top = sums.where("value is not null").orderBy(F.desc("count"), "value").limit(k + 1)
    lost = sums.where("value is null").select(F.col("delta").alias("lost"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = top.withColumn("cut", F.coalesce(F.element_at(F.collect_list("count").over(order), -1), F.lit(0.0))).withColumn("n", F.count(F.lit(1)).over(order))
    cut = cut.withColumn("cut", F.when(F.col("n") > k, F.col("cut")).otherwise(0.0))
    # one row of lost weight meets at most k + 1 rows
    return (
        cut.join(F.broadcast(lost.agg(F.coalesce(F.sum("lost"), F.lit(0.0)).alias("lost"))))
        .where(F.col("count") > F.col("cut"))
        .select("value", (F.col("count") + F.col("lost")).alias("count"), (F.col("cut") + F.col("lost")).alias("delta"))
    )


_SUMMARY = "struct<k:int,delta:double,counts:array<struct<value:binary,count:double>>>"


def _summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., sketch) from (by.., value, count, k, lost) rows: counters cut by the (k + 1)-th largest, as JSON bytes.

    Only k + 1 counters of a group are gathered; the limit acts before the shuffle. Counters cut to nothing stay among the k.
    """
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("count"), "value")
    top = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("k") + 1)
    kept = top.groupBy(*by).agg(
        F.max("k").alias("k"), F.max("lost").alias("lost"), F.coalesce(F.max(F.when(F.col("r") == F.col("k") + 1, F.col("count"))), F.lit(0.0)).alias("cut"),
        F.collect_list(F.when(F.col("r") <= F.col("k"), F.struct("value", "count"))).alias("counts"),
    )
    counts = F.array_sort(F.transform("counts", lambda c: F.struct(c["value"].alias("value"), (c["count"] - F.col("cut")).alias("count"))))
    packed = F.to_json(F.struct("k", (F.col("lost") + F.col("cut")).alias("delta"), counts.alias("counts")))
    return kept.select(*by, F.encode(packed, "UTF-8").alias("sketch"))


def counters(df: DataFrame, column: str, k: int, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by.., value, count): of each group and task at most k counters, and a row without a value: the weight that each lacks.

    Tasks keep the counters while rows stream by; the smallest ones give way before anything is shuffled.
    """
    if k < 1:
        raise ValueError("a sketch needs one bucket at least")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, F.col(column).cast("string").cast("binary").alias("value"), w.alias("count")).where("value is not null and count > 0 and not isnan(count)")
    return rows.mapInArrow(counter_rows(list(by), k), rows.schema)


def summary(df: DataFrame, column: str, k: int, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by.., sketch): a serialised Misra-Gries summary of k counters for each group. Values are kept as text bytes.

    What is shuffled are the tasks' counters, k + 1 rows of a group and task at most. Counters are below their value's
    weight by delta at most, and delta is at most the group's weight / (k + 1).
    """
    by = list(by)
    parts = counters(df, column, k, weight, by)
    sums = parts.groupBy(*by, "value").agg(F.sum("count").alias("count"))
    lost = sums.where("value is null").groupBy(*by).agg(F.sum("count").alias("lost"))
    return _summary(_with_group(sums.where("value is not null"), lost, by, "left").fillna(0.0, ["lost"]).withColumn("k", F.lit(k)), by)


def _with_group(counts: DataFrame, one: DataFrame, by: list[str], how: str) -> DataFrame:
    """counts with the columns of their group's row; null keys are keys."""
    if not by:
        return counts.join(F.broadcast(one), how=how, on=F.lit(True))  # one row
    named = one.withColumnsRenamed({c: f"_{c}" for c in by})
    return counts.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], how).drop(*(f"_{c}" for c in by))


def summary_merge(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Summaries of a group merged: counters of a value add up, and so do deltas. Different sizes are an error."""
    by = list(by)
    held = sketches.select(*by, F.from_json(F.decode("sketch", "UTF-8"), _SUMMARY).alias("s"))
    same = F.when(F.min("s.k") == F.max("s.k"), F.max("s.k")).otherwise(F.raise_error(F.lit("sketches of different sizes don't merge")).cast("int"))
    whole = held.groupBy(*by).agg(same.alias("k"), F.sum("s.delta").alias("lost"))
    counts = held.select(*by, F.explode("s.counts").alias("c")).groupBy(*by, F.col("c.value").alias("value")).agg(F.sum("c.count").alias("count"))
    return _summary(_with_group(counts, whole, by, "inner"), by)


def summary_counts(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by.., value, count, delta) of summaries: count is an upper bound, too high by delta at most."""
    held = sketches.select(*by, F.from_json(F.decode("sketch", "UTF-8"), _SUMMARY).alias("s")).select(*by, F.col("s.delta").alias("delta"), F.explode("s.counts").alias("c"))
    return held.select(*by, F.decode("c.value", "UTF-8").alias("value"), (F.col("c.count") + F.col("delta")).alias("count"), "delta")
