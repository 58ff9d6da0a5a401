"""Fixed-size summaries of columns of any length: added up on the executors, slice by slice, and broadcast.

A summary has the same few MB whatever the input is. It is only used to order or to skip work, never to decide a
result: a filled-up Bloom filter lets more rows through to the join that decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lean, mix

SLICES = 16
BITS = 1 << 25

_SCHEMA = "slice int, salt int, data binary"


def reduced(df: DataFrame, size: int, kind, of_batch, merge) -> np.ndarray:
    """of_batch(total, batch) adds a batch of df to an array of `size`; merge(a, b) joins such arrays."""
    width = size // SLICES

    def out(rows):
        s, salt, data = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(salt, pa.int32()), pa.array(data, pa.binary())], ["slice", "salt", "data"])

    def first(batches):
        total, any_ = np.zeros(size, kind), False
        for batch in batches:
            if batch.num_rows:
                any_ = True
                of_batch(total, batch)
        if any_:
            salt = TaskContext.get().partitionId() % 32
            for s in range(SLICES):
                yield out([(s, salt, total[s * width : (s + 1) * width].tobytes())])

    def again(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                part = np.frombuffer(data.as_buffer(), kind)
                sums[s] = merge(sums[s], part) if s in sums else part.copy()
        for s, part in sums.items():
            yield out([(s, 0, part.tobytes())])

    parts = df.mapInArrow(lean(first), _SCHEMA)
    for by in (("slice", "salt"), ("slice",)):
        parts = parts.repartition(SLICES, *by).mapInArrow(lean(again), _SCHEMA)
    result = np.zeros(size, kind)
    for r in parts.collect():  # SLICES rows
        result[r.slice * width : (r.slice + 1) * width] = np.frombuffer(bytes(r.data), kind)
    return result


def _places(keys: np.ndarray, bits: int):
    h = mix(keys.view(np.uint64) + np.uint64(1))
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)


class Bloom:
    """A filled filter, shared with the executors: bits / 8 bytes, whatever the input."""

    def __init__(self, spark, filled: np.ndarray, bits: int):
        self.shared, self.bits, self.filled = spark.sparkContext.broadcast(filled), bits, bool(filled.any())

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False only where a key was not put in; in a task."""
        a, b = _places(keys, self.bits)
        data = self.shared.value
        return (data[a >> 3] >> (a & 7).astype(np.uint8) & 1 & (data[b >> 3] >> (b & 7).astype(np.uint8))).astype(bool)

    def test(self, column):
        """holds() as a column, of a long column; false where it is null."""

        @F.pandas_udf("boolean")
        def test(column: pd.Series) -> pd.Series:
            known = column.notna().to_numpy()
            out = np.zeros(len(column), bool)
            out[known] = self.holds(column.to_numpy()[known].astype(np.int64))
            return pd.Series(out)

        return test(column)

    def __getstate__(self):
        return {"shared": self.shared, "bits": self.bits, "filled": self.filled}


def bloom(keys: DataFrame, bits: int = BITS) -> Bloom:
    """A filter of one long column."""

    def add(total, batch):
        for p in _places(batch.column(0).drop_null().to_numpy(), bits):
            np.bitwise_or.at(total, p >> 3, (1 << (p & 7)).astype(np.uint8))

    return Bloom(keys.sparkSession, reduced(keys, bits // 8, np.uint8, add, np.bitwise_or), bits)


def maybe_in(keys: DataFrame, bits: int = BITS):
    """A function of a long column: false only where no row of keys (one long column) has the value, or it is null."""
    return bloom(keys, bits).test
