"""Kernels of the mergeable one-pass sketches, and how tasks keep them by group.

`Ranks` summarises weighted values by bounds of their ranks; `Stream` keeps levels of such summaries, so that its size
depends on the error allowed and not on how much it has seen. `Counters` keeps at most k counters of each group. Both
are fed with Arrow batches inside tasks; only sketches leave a task. Where a task meets more groups than it may hold,
it gives out what it has and begins anew: sketches of one group merge later.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

LEVELS = 24  # of a stream; the last one takes what comes after, 2**23 full buffers on
HELD = 1_000_000  # numbers or counters that a task keeps over all groups
_HEAD = struct.Struct(">4sdd")  # error and eps; as they aren't negative, bytes of the error sort like the error
_MAGIC = b"wrk1"


class Ranks:
    """Values in ascending order with bounds of their place: at least `low` of the weight is below a value, at most
    `high` is up to and with it, and at least `w` is the value's own."""

    __slots__ = ("v", "low", "high", "w")

    def __init__(self, v: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray):
        self.v, self.low, self.high, self.w = v, low, high, w

    @classmethod
    def exact(cls, v: np.ndarray, w: np.ndarray) -> "Ranks":
        v, of = np.unique(v, return_inverse=True)
        w = np.bincount(of, w, len(v)) if len(v) else np.zeros(0)
        high = np.cumsum(w)
        return cls(v, np.concatenate([[0.0], high[:-1]]) if len(v) else high, high, w)

    def __len__(self) -> int:
        return len(self.v)

    @property
    def total(self) -> float:
        return float(self.high[-1]) if len(self.v) else 0.0

    def error(self) -> float:
        """The share of the weight by which a rank may be off."""
        if not len(self.v) or not self.total:
            return 0.0
        own = (self.high - self.low - self.w).max()
        between = (self.high[1:] - self.w[1:] - self.low[:-1] - self.w[:-1]).max(initial=0.0)
        return max(0.0, float(max(own, between)) / self.total)

    def _at(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The three numbers for any ascending values."""
        i = np.searchsorted(self.v, v)
        inside = np.minimum(i, len(self.v) - 1)
        held = self.v[inside] == v
        low = np.concatenate([[0.0], self.low + self.w])[i]
        high = np.concatenate([self.high - self.w, [self.total]])[i]
        return np.where(held, self.low[inside], low), np.where(held, self.high[inside], high), np.where(held, self.w[inside], 0.0)

    def merge(self, other: "Ranks") -> "Ranks":
        """Both together; the error is no larger than the larger one."""
        if not len(self) or not len(other):
            return self if len(self) else other
        v = np.union1d(self.v, other.v)
        return Ranks(v, *(a + b for a, b in zip(self._at(v), other._at(v))))

    def prune(self, n: int) -> "Ranks":
        """At most n + 1 of the values, the first and the last among them, at the cost of 1 / n in error."""
        if len(self) <= n + 1:
            return self
        d = np.arange(1, n) * (2.0 * self.total / n)
        i = np.clip(np.searchsorted(self.low + self.high, d, "right") - 1, 0, len(self) - 2)
        right = d >= self.low[i] + self.w[i] + self.high[i + 1] - self.w[i + 1]
        keep = np.unique(np.concatenate([[0], i + right, [len(self) - 1]]))
        return Ranks(self.v[keep], self.low[keep], self.high[keep], self.w[keep])

    def fit(self, eps: float) -> "Ranks":
        """Pruned as far as an error of eps allows."""
        room = eps - self.error()
        return self.prune(max(1, math.ceil(1 / room))) if room > 1e-12 else self

    def quantiles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries 0..n and their cumulative weights: the first value whose weight is above r / n of all, or the last."""
        upto = (self.low + self.w + self.high) / 2
        i = np.minimum(np.searchsorted(upto, np.arange(n + 1) * self.total / n, "right"), len(self) - 1)
        return self.v[i], upto[i]

    def to_bytes(self, eps: float) -> bytes:
        return _HEAD.pack(_MAGIC, self.error(), eps) + np.stack([self.v, self.low, self.high, self.w]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["Ranks", float]:
        if len(data) < _HEAD.size or (len(data) - _HEAD.size) % 32 or data[:4] != _MAGIC:
            raise ValueError("these bytes are no quantile sketch")
        return cls(*np.frombuffer(data, "<f8", offset=_HEAD.size).reshape(4, -1)), _HEAD.unpack_from(data)[2]


class Stream:
    """A summary of values as they come, within eps of every rank: level i stands for 2**i buffers."""

    def __init__(self, eps: float):
        self.size = max(2, math.ceil(LEVELS / eps))
        self.levels: list[Ranks | None] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.held = 0

    def add(self, v: np.ndarray, w: np.ndarray) -> None:
        self.parts.append((v, w))
        self.waiting += len(v)
        self.held += len(v)
        if self.waiting >= 2 * self.size:
            self.push(self._buffer())

    def _buffer(self) -> Ranks:
        parts, self.parts = self.parts, []
        self.held -= self.waiting
        self.waiting = 0
        return Ranks.exact(*(np.concatenate(x) for x in zip(*parts))) if parts else Ranks.exact(np.zeros(0), np.zeros(0))

    def push(self, r: Ranks) -> None:
        """A summary, as one more buffer."""
        r, i = r.prune(self.size), 0
        while i < len(self.levels) and self.levels[i] is not None:
            self.held -= len(self.levels[i])
            r = r.merge(self.levels[i]).prune(self.size)
            self.levels[i] = None
            i = min(i + 1, LEVELS - 1)
        if i == len(self.levels):
            self.levels.append(None)
        self.levels[i] = r
        self.held += len(r)

    def result(self) -> Ranks:
        r = self._buffer()
        for level in self.levels:
            if level is not None:
                r = r.merge(level)
        return r


def groups(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """For each row the number of its group in this batch, and the groups' keys. Nulls are a key like others."""
    if not by:
        return np.zeros(batch.num_rows, np.int64), [()] if batch.num_rows else []
    code = np.zeros(batch.num_rows, np.int64)
    for name in by:
        column = batch.column(name).dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(1, len(column.dictionary)) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, of = np.unique(code, return_index=True, return_inverse=True)
    columns = [batch.column(name).take(pa.array(first)).to_pylist() for name in by]
    return of, list(zip(*columns))


def same_key(a: tuple | None, b: tuple) -> bool:
    return a is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b))


def keyed_rows(keys: list[tuple], by: list[str], kinds: list[pa.DataType], rest: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*columns, *rest.values()], [*by, *rest])


def rank_sketches(by: list[str], eps: float):
    """A function of Arrow batches (by.., _value, _weight): sketches of their groups, within a quarter of eps."""

    def run(batches: Iterator[pa.RecordBatch]):
        state: dict[tuple, Stream] = {}
        kinds: list[pa.DataType] = []

        def out():
            keys, streams = list(state), list(state.values())
            state.clear()
            for i in range(0, len(keys), 1000):
                held = [s.result().fit(eps / 4).to_bytes(eps) for s in streams[i : i + 1000]]
                yield keyed_rows(keys[i : i + 1000], by, kinds, {"sketch": pa.array(held, pa.binary())})

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in by]
            of, keys = groups(batch, by)
            v, w = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_value", "_weight"))
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=len(keys))) if len(keys) else []
            v, w, start = v[order], w[order], 0
            for key, end in zip(keys, ends):
                stream = state.get(key)
                if stream is None:
                    stream = state[key] = Stream(eps / 8)
                stream.add(v[start:end], w[start:end])
                start = end
            if len(state) > 1 and sum(s.held + 16 for s in state.values()) > HELD:
                yield from out()
        yield from out()

    return run


def merged_ranks(by: list[str]):
    """A function of Arrow batches (by.., sketch), sorted by `by` and the largest error first: one sketch for each group.

    Of what the largest error leaves of eps, a merge uses up half at most, so sketches can be merged as often as is wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        now, kinds = None, []
        stream = share = promised = None

        def out():
            r = stream.result()
            return keyed_rows([now], by, kinds, {"sketch": pa.array([r.fit(r.error() + share).to_bytes(promised)], pa.binary())})

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in by]
            columns = [batch.column(n).to_pylist() for n in by]
            for i, data in enumerate(batch.column("sketch")):
                if not data.is_valid:
                    continue
                ranks, eps = Ranks.from_bytes(data.as_py())
                key = tuple(c[i] for c in columns)
                if not same_key(now, key):
                    if stream is not None:
                        yield out()
                    now, promised = key, eps
                    share = max(1e-9, (promised - ranks.error()) / 4)
                    stream = Stream(share)
                promised = max(promised, eps)
                stream.push(ranks)
        if stream is not None:
            yield out()

    return run


class Counters:
    """At most k counters of each group, and the weight `delta` by which they may be too low: a row without a value.

    The rows of a batch join the counters, are summed by group and value, and each group is cut by its (k + 1)-th largest
    counter. So k + 1 units of weight go for each one that delta grows by. Counters cut to nothing stay while there is room.
    """

    def __init__(self, by: list[str], k: int):
        self.by, self.k = by, k
        self.table: pa.Table | None = None
        self.parts: list[pa.Table] = []
        self.waiting = 0

    def add(self, batch: pa.Table) -> None:
        """Rows (by.., value, count); those without a value are deltas."""
        self.parts.append(batch)
        self.waiting += batch.num_rows
        if self.waiting > max(1 << 17, self.table.num_rows if self.table is not None else 0):
            self.cut()

    def cut(self) -> pa.Table:
        whole = pa.concat_tables([*([self.table] if self.table is not None else []), *self.parts])
        self.parts, self.waiting = [], 0
        names = [*self.by, "value"]
        summed = whole.group_by(names, use_threads=False).aggregate([("count", "sum")]).rename_columns([*names, "count"]).combine_chunks()
        batch = summed.to_batches()[0] if summed.num_rows else None
        if batch is not None:
            of, keys = groups(batch, self.by)
            value, count = batch.column("value"), batch.column("count").to_numpy(zero_copy_only=False).copy()
            is_value = np.asarray(value.is_valid())
            rank = np.zeros(len(of), np.int64)
            rank[pa.compute.sort_indices(value).to_numpy()] = np.arange(len(of))  # ties by value
            order = np.lexsort((rank, -count, ~is_value, of))
            size = np.bincount(of, is_value, len(keys)).astype(np.int64)
            start = np.searchsorted(of[order], np.arange(len(keys)))
            cut = np.zeros(len(keys))
            full = size > self.k
            cut[full] = count[order[start[full] + self.k]]
            place = np.empty(len(of), np.int64)
            place[order] = np.arange(len(of)) - start[of[order]]
            keep = ~is_value | (place < self.k)
            count[is_value] -= cut[of[is_value]]
            lost = np.flatnonzero(cut > 0)
            rows = summed.set_column(len(names), "count", pa.array(count)).filter(pa.array(keep))
            deltas = keyed_rows([keys[i] for i in lost], self.by, [batch.schema.field(n).type for n in self.by], {"value": pa.nulls(len(lost), value.type), "count": pa.array(cut[lost])})
            summed = pa.concat_tables([rows, pa.Table.from_batches([deltas])])
        self.table = summed
        return summed


def counter_rows(by: list[str], k: int):
    """A function of Arrow batches (by.., value, count): counters and deltas of their groups."""

    def run(batches: Iterator[pa.RecordBatch]):
        state = Counters(by, k)
        for batch in batches:
            state.add(pa.Table.from_batches([batch]))
            if state.table is not None and state.table.num_rows > HELD:
                yield from state.table.to_batches()
                state.table = None
        if state.parts or state.table is not None:
            yield from state.cut().combine_chunks().to_batches()

    return run
