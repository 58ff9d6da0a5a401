"""Batches that are filled greedily up to a number of bytes, over rows in any number of tasks.

A batch takes rows in order until their sizes reach the target, and the next one begins empty. Where batches end
depends on all rows before, but a range of rows needs only one number from them: what the open batch holds when the range
begins. So each range is summed up as a function of this number: which row closes the open batch, how many batches close after
it, and what is open at the end. It is a step function with no more steps than rows that one batch can hold. The
functions of a range's neighbours are composed, up a tree of ranges of 2**16, 2**32 and 2**48 order numbers; back down the tree
each range learns what is open where it begins, and cuts its rows. No task sees more than a range's rows or its children's functions, one
after the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.relational import BYTE_TARGET, batch_weight

_STEP = "low array<long>, closed array<long>, held array<long>"
STEPS = 16  # bits of the order that a level of the tree takes up


@dataclass
class Filling:
    """For an open batch that holds c when a range begins, with low[i] <= c < low[i + 1]: closed[i] batches close within the
    range, and held[i] is open at its end; where none closes (closed 0), held[i] is added to c."""

    low: np.ndarray
    closed: np.ndarray
    held: np.ndarray

    def __call__(self, c):
        i = np.searchsorted(self.low, c, "right") - 1
        return self.closed[i], np.where(self.closed[i] > 0, self.held[i], c + self.held[i])

    def then(self, other: "Filling") -> "Filling":
        """Both ranges as one."""
        ends = np.append(self.low[1:], np.iinfo(np.int64).max)
        quiet = self.closed == 0  # at most the first step: c grows, and the next range's steps lie that much lower
        low = [self.low]
        for i in np.flatnonzero(quiet):
            shifted = other.low - self.held[i]
            low.append(shifted[(shifted > self.low[i]) & (shifted < ends[i])])
        low = np.unique(np.concatenate(low))
        first, c = self(low)
        more, held = other(c)
        # where neither closes, held is what both add
        still = (first + more) == 0
        out = Filling(low, first + more, np.where(still, held - low, held))
        same = (out.closed[1:] == out.closed[:-1]) & (out.held[1:] == out.held[:-1])
        keep = np.concatenate([[True], ~same])
        return Filling(out.low[keep], out.closed[keep], out.held[keep])


def filling(sizes: np.ndarray, target: int) -> Filling:
    """The function of a range of rows."""
    upto = np.cumsum(sizes)
    n, total = len(sizes), int(upto[-1])
    # beginning empty at row j: the row that closes the batch, and so on from the one after it
    closing = np.searchsorted(upto, np.concatenate([[0], upto[:-1]]) + target)
    closed, held = [0] * (n + 1), [0] * (n + 1)
    before = [0, *upto.tolist()]
    for j, i in zip(range(n - 1, -1, -1), closing[::-1].tolist()):
        closed[j], held[j] = (1 + closed[i + 1], held[i + 1]) if i < n else (0, total - before[j])
    # row i closes a batch that holds target - upto[i] or more, but less than would have closed one row earlier
    at = np.arange(min(n - 1, int(np.searchsorted(upto, target))), -1, -1)
    low = target - upto[at]
    if low[0] > 0:
        return Filling(np.concatenate([[0], low]), np.array([0, *(1 + closed[i + 1] for i in at)]), np.array([total, *(held[i + 1] for i in at)]))
    low[0] = 0
    return Filling(low, np.array([1 + closed[i + 1] for i in at]), np.array([held[i + 1] for i in at]))


def _same_runs(column: pa.Array):
    """(value, begin, end) of each run of equal values."""
    v = column.to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(v)) + 1, [len(v)]]) if len(v) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(v[a]), int(a), int(b)


def _out(name: str, key: int, f: Filling) -> pa.RecordBatch:
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (f.low, f.closed, f.held)]
    return pa.RecordBatch.from_arrays([pa.array([key]), *lists], [name, "low", "closed", "held"])


def _from(batch: pa.RecordBatch, i: int) -> Filling:
    return Filling(*(batch.column(c)[i].values.to_numpy() for c in ("low", "closed", "held")))


def batch_ids_by_bytes(df: DataFrame, order: str, size: Column, target: int = BYTE_TARGET, weigh: bool = True) -> DataFrame:
    """Df with batch_id: rows by `order`, a column of whole numbers, filled greedily into batches of `target` bytes.

    A batch closes with the row that reaches the target. With weigh, small rows count for a share of the target, so that a batch
    has MOST_ROWS rows at most (see batch_weight). Rows of one order number go by size; negative or null sizes are none.
    """
    if target < 1:
        raise ValueError("a batch holds one byte at least")
    size = F.greatest(F.coalesce((batch_weight(size) if weigh else size).cast("long"), F.lit(0)), F.lit(0).cast("long"))
    rows = df.withColumns({"_size": size, "_b": F.shiftright(F.col(order).cast("long"), STEPS)})

    def summed(batches):
        key, parts = None, []
        for batch in batches:
            w = batch.column(1).to_numpy()
            for k, a, b in _same_runs(batch.column(0)):
                if k != key and parts:
                    yield _out("_b", key, filling(np.concatenate(parts), target))
                    parts = []
                key = k
                parts.append(w[a:b])
        if parts:
            yield _out("_b", key, filling(np.concatenate(parts), target))

    def composed(batches):
        key, f = None, None
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k != key and f is not None:
                    yield _out("parent", key, f)
                    f = None
                key, f = k, _from(batch, i) if f is None else f.then(_from(batch, i))
        if f is not None:
            yield _out("parent", key, f)

    dealt = rows.select("_b", order, "_size").repartition("_b").sortWithinPartitions("_b", order, "_size").select("_b", "_size")
    levels = [dealt.mapInArrow(summed, f"_b long, {_STEP}")]
    for _ in range(2):
        below = levels[-1].select(F.shiftright("_b", STEPS).alias("parent"), "_b", "low", "closed", "held")
        below = below.repartition("parent").sortWithinPartitions("parent", "_b").drop("_b")
        levels.append(below.mapInArrow(composed, f"parent long, {_STEP}").withColumnRenamed("parent", "_b"))

    def entered(batches):
        """What is open where each child begins, from what is open where its parent does."""
        key = c = base = None
        for batch in batches:
            parent, child = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, number = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for i in range(batch.num_rows):
                if parent[i] != key:
                    key, c, base = parent[i], start[i], number[i]
                out.append((child[i], c, base))
                closed, held = _from(batch, i)(np.array(c))
                c, base = int(held), base + int(closed)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["_b", "_open", "_base"]) if out else pa.RecordBatch.from_pydict({n: pa.array([], pa.int64()) for n in ("_b", "_open", "_base")})

    top = levels[-1].select(F.lit(0).cast("long").alias("parent"), "_b", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"), "low", "closed", "held")
    known = top.repartition(1).sortWithinPartitions("_b").mapInArrow(entered, "_b long, _open long, _base long")  # 2**15 rows at most
    for level in levels[-2::-1]:
        above = known.select(F.col("_b").alias("parent"), F.col("_open").alias("s"), F.col("_base").alias("n"))
        here = level.withColumn("parent", F.shiftright("_b", STEPS)).join(above, "parent").select("parent", "_b", "s", "n", "low", "closed", "held")
        known = here.repartition("parent").sortWithinPartitions("parent", "_b").mapInArrow(entered, "_b long, _open long, _base long")

    names, schema = df.columns, T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])

    def cut(batches):
        key = c = number = None
        for batch in batches:
            w, begin, base = (batch.column(n).to_numpy() for n in ("_size", "_open", "_base"))
            ids = np.zeros(batch.num_rows, np.int64)
            for k, a, b in _same_runs(batch.column("_b")):
                if k != key:
                    key, c, number = k, int(begin[a]), int(base[a])
                upto, at = np.cumsum(w[a:b]), 0
                while at < b - a:
                    past = int(upto[at - 1]) if at else 0
                    i = int(np.searchsorted(upto, past + target - c))
                    ids[a + at : a + i + 1] = number
                    if i >= b - a:
                        c += int(upto[-1]) - past
                        break
                    at, c, number = i + 1, 0, number + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids)], [*names, "batch_id"])

    placed = rows.join(known, "_b").repartition("_b").sortWithinPartitions("_b", order, "_size")
    return placed.mapInArrow(cut, schema)
