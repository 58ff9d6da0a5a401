"""Suffix-array dedup by depth-limited radix passes.

A repeated passage is a string of `depth` bytes that starts at two places: a group of suffixes that are equal through
their first `depth` bytes. Most-significant-digit passes find these groups without sorting every suffix to that depth:
a pass deals suffixes by a digit, that is by some more of their bytes, and what is alone there is done.

1. Suffixes are handled by runs: each window of `depth` bytes is anchored at one of its GRAM-byte grams, the one of
   smallest hash (leftmost if tied). The choice depends on the window's bytes alone, so equal windows are anchored at
   equal grams at equal offsets. Consecutive windows with one anchor are a run; there are some 13 for each thousand
   bytes. The gram is the first digit, and runs whose gram is found nowhere else are done: counts of grams show it, and
   a filter of fixed size keeps these runs out of all that follows. Runs whose whole bytes are found again are repeated
   throughout, and only one of equal ones goes on, if others share its gram.
2. The anchor is the core of a run's windows, the bytes that all of them hold. A window holds at least half of what it
   has beside the core before it, or else after it: the core so extended is the next digit, and parts a run in two.
   Groups of one core of up to BUFFER bytes are finished in a task, by passes over their windows' bytes, eight at a
   time, which only equal prefixes survive. Larger groups (the windows around a very frequent line) take another pass
   of this kind. They never meet in one task before their cores are the whole windows: then all of them are repeated.

The bytes that repeated windows cover are removed, in every place. Matches never cross documents. Digits are compared as
bytes; only runs that share their gram are told apart by 64-bit hashes of the rest.

Rows are told apart by a 128-bit hash of their texts, so rows with equal or null ids are documents of their own, and
copies of a text are repeated passages of each other. Nulls are empty texts; texts shorter than `depth` stay whole. An
empty table gives an empty table. Columns besides doc_id and text are not read; cleaned() hands them on as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import bloom, maybe_in
from .store import bounded_batches, persisted
from .text import chunks, lean, prefix_sums, range_hash, utf8

DEPTH = 200
GRAM = 50
BUFFER = 1 << 20  # bytes of runs up to which a group is finished in a task
STEP = 1 << 20  # bytes of groups that are compared at a time
SUMMED = 500_000  # runs that a task sums before the shuffle
SLICE = 1 << 19  # bytes of a text that are cut into runs at a time
BITS = 12  # of a run's length, and of its gram's place in it


def _runs(buf: np.ndarray, offsets: np.ndarray, depth: int, gram: int):
    """Runs of windows: row, first window, number of windows, gram's place in the run, hash of gram and of all bytes."""
    n = len(buf) - gram + 1
    size = np.diff(offsets)
    if n < 1 or not (size >= depth).any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z
    s = prefix_sums(buf)
    at = np.arange(n)
    h = range_hash(s, at, at + gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, want = 1, depth - gram + 1
    while span * 2 <= want:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    if span < want:
        key = np.minimum(key[: len(key) - (want - span)], key[want - span :])
    row = np.repeat(np.arange(len(size)), np.maximum(0, size - depth + 1))
    first = np.maximum(0, size - depth + 1)
    start = np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first) + offsets[:-1][row]
    place = (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.ones(len(row), bool)
    cut[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(cut)
    count = np.diff(np.append(a, len(row)))
    lo = start[a]
    return row[a], lo - offsets[:-1][row[a]], count, place[a] - lo, h[place[a]], range_hash(s, lo, lo + count - 1 + depth).view(np.int64)


def _sliced(buf: np.ndarray, offsets: np.ndarray, depth: int, gram: int):
    """_runs of texts, and the grams' bytes; texts of more than SLICE bytes are taken in slices that overlap."""
    for i, j in chunks(offsets, SLICE):
        for a in range(int(offsets[i]), int(offsets[j]) if j == i + 1 else int(offsets[i]) + 1, SLICE):
            b = min(int(offsets[j]), a + SLICE + depth - 1) if j == i + 1 else int(offsets[j])
            off = np.array([a, b]) if j == i + 1 else offsets[i : j + 1]
            part = buf[a:b]
            row, lo, n, at, g, c = _runs(part, off - a, depth, gram)
            first = off[row] - a + lo + at
            yield i + row, lo + (a - int(offsets[i]) if j == i + 1 else 0), n, at, g, c, lambda some, part=part, first=first: part[first[some][:, None] + np.arange(gram)]


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _equal_windows(buf: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which windows of buf (at their starts) have all their bytes in common with another one of their group.

    Most significant digits first, eight bytes each. A pass parts groups whose windows differ in the digit, and only
    windows that still have company go on.
    """
    digits = np.ndarray(len(buf), ">u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    live = np.argsort(group, kind="stable")
    g = group[live]
    for d in range(0, depth + 8, 8):
        head = np.flatnonzero(np.diff(g, prepend=-1))
        size = np.diff(np.append(head, len(g)))
        keep = np.repeat(size > 1, size)
        live, g = live[keep], g[keep]
        if d >= depth or not len(live):
            break
        head = np.flatnonzero(np.diff(g, prepend=-1))
        size = np.diff(np.append(head, len(g)))
        digit = digits[at[live] + d].astype(np.uint64) >> np.uint64(8 * max(0, 8 - (depth - d)))
        other = np.add.reduceat(digit != np.repeat(digit[head], size), head) > 0
        if other.any():
            some = np.flatnonzero(np.repeat(other, size))
            order = some[np.lexsort((digit[some], g[some]))]
            live[some], digit[some] = live[order], digit[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])
            g = np.cumsum(new)
    same = np.zeros(len(at), bool)
    same[live] = True
    return same


def _merged(pairs, depth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges that windows cover, from (first window, number) pairs."""
    if not len(pairs):
        z = np.zeros(0, np.int64)
        return z, z
    p = np.array(sorted(pairs), np.int64)
    a, b = p[:, 0], np.minimum(p[:, 0] + p[:, 1] - 1 + depth, size)
    b = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    i = np.flatnonzero(new)
    return a[i], b[np.append(i[1:], len(a)) - 1]


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"), *columns)


def _extended(raw: bytes, lo: int, core: int, width: int, depth: int, key: bytes):
    """The two parts of a run (raw from its first window on, at lo; core within raw) with a longer core each.

    Windows that hold `half` bytes before the core, and those that don't, which hold the more after it.
    """
    free = depth - width
    half = (free + 1) // 2
    n = len(raw) - depth + 1
    mid = min(max(0, core - half + 1), n)
    if mid:
        yield key + b"<", raw[core - half : core + width], raw[: mid - 1 + depth], lo, core - half
    if n > mid:
        yield key + b">", raw[core : core + width + free - half + 1], raw[mid:], lo + mid, core - mid


CORES = "side binary, core binary, t1 long, t2 long, lo long, place int, ask boolean, raw binary"
CORE_TYPES = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())


def _core_batches(rows, limit: int = 4 << 20):
    """Batches of CORES rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + len(row[1]) + 200
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), CORE_TYPES)], names=[x.split()[0] for x in CORES.split(", ")])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), CORE_TYPES)], names=[x.split()[0] for x in CORES.split(", ")])


def _compared(batches, depth: int):
    """Repeated windows, as (t1, t2, lo, n), of whole groups of rows with equal side and core, sorted by them."""

    def groups(t):
        keys = list(zip(t["side"].to_pylist(), t["core"].to_pylist()))
        group = np.cumsum([0, *(a != b for a, b in zip(keys[1:], keys))])
        pick = np.flatnonzero(np.bincount(group)[group] > 1)
        t, group = t.take(pa.array(pick)), group[pick]
        raws = t["raw"].to_pylist()
        buf = np.frombuffer(b"".join(raws), np.uint8)
        size = np.array([len(x) for x in raws], np.int64)
        n = size - depth + 1
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        same = _equal_windows(buf, (np.cumsum(size) - size)[row] + off, group[row], depth)
        same &= t["ask"].to_numpy()[row]
        i = np.flatnonzero(same)
        lo = t["lo"].to_numpy()[row[i]] + off[i]
        cut = np.ones(len(i), bool)
        cut[1:] = (row[i][1:] != row[i][:-1]) | (lo[1:] != lo[:-1] + 1)
        a = np.flatnonzero(cut)
        r = row[i[a]]
        cols = [t["t1"].to_numpy()[r], t["t2"].to_numpy()[r], lo[a], np.diff(np.append(a, len(i))).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t1", "t2", "lo", "n"])

    held, size, last = [], 0, None
    for batch in batches:
        keys, sizes = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), pc.binary_length(batch.column(7))
        start = 0
        for k, (key, n) in enumerate(zip(keys, sizes.to_pylist())):
            if key != last and size >= STEP:
                held.append(batch.slice(start, k - start))
                yield groups(pa.Table.from_batches(held).combine_chunks())
                held, size, start = [], 0, k
            last = key
            size += n
        held.append(batch.slice(start))
    if size:
        yield groups(pa.Table.from_batches(held).combine_chunks())


def repeated(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, runs): for each text with repeated windows, the (lo, n) runs of their starts."""
    if not 0 < gram <= depth < 1 << BITS:
        raise ValueError("gram and depth must be positive, gram at most depth, depth below 4096")
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)

    def counted(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, _, _, g, _, _ in _sliced(*utf8(batch.column(2)), depth, gram):
                held.append(g)
                size += len(g)
                if size >= SUMMED:
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)

    def summed(held):
        g, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(times)], ["g", "times"])

    # counts of grams, by their hashes, summed before the shuffle; a filter of fixed size of those that are found again
    counts = keyed.mapInArrow(lean(counted), "g long, times long").groupBy("g").agg(F.sum("times").alias("times"))
    again = bloom(counts.where("times > 1").select("g"))

    def placed(batches):
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, lo, n, at, g, c, grams in _sliced(*utf8(batch.column(2)), depth, gram):
                i = np.flatnonzero(again.holds(g.view(np.int64)))
                row = row[i]
                cols = [_binary(grams(i)), pa.array(c[i]), pa.array(t1[row]), pa.array(t2[row]), pa.array(lo[i] << 2 * BITS | n[i] << BITS | at[i])]
                yield pa.RecordBatch.from_arrays(cols, ["g", "c", "t1", "t2", "place"])

    found = persisted(keyed.mapInArrow(lean(placed), "g binary, c long, t1 long, t2 long, place long"), "runs")
    mark = F.col("t1").bitwiseXOR(F.col("t2")).bitwiseXOR(F.col("place"))  # one of equal runs is chosen by the smallest
    same = persisted(found.groupBy("g", "c").agg(F.count(F.lit(1)).alias("times"), F.min(mark).alias("first")), "digits")
    grams = same.groupBy("g").agg(F.count_if(F.col("times") == 1).alias("alone"), F.sum("times").alias("all")).where("all > 1 and alone > 0").select("g")
    mixed = same.join(grams, "g").select("g", "c", "first", (F.col("times") > 1).alias("whole"))
    whole = same.where("times > 1").join(grams, "g", "left_anti").select("g", "c", F.lit(None).cast("long").alias("first"), F.lit(True).alias("whole"))
    low = F.lit((1 << BITS) - 1)
    found = (
        found.join(mixed.union(whole), ["g", "c"])
        .withColumn("go_on", F.coalesce(mark == F.col("first"), F.lit(False)))
        .where("whole or go_on")
        .groupBy("t1", "t2")
        .agg(
            F.collect_set(
                F.struct(
                    F.shiftright("place", 2 * BITS).alias("lo"),
                    F.shiftright("place", BITS).bitwiseAND(low).cast("int").alias("n"),
                    F.col("place").bitwiseAND(low).cast("int").alias("at"),
                    "whole",
                    "go_on",
                )
            ).alias("runs")
        )
    )
    found = persisted(found, "found")

    going = found.where(F.exists("runs", lambda r: r["go_on"])).select("t1")
    texts = keyed.where(maybe_in(going)("t1")).withColumn("i", F.row_number().over(Window.partitionBy("t1", "t2").orderBy("t1"))).where("i = 1").drop("i")
    left = found.select("t1", "t2", F.filter("runs", lambda r: r["go_on"]).alias("runs")).where(F.size("runs") > 0)

    def second_digit(batches):
        def rows():
            for batch in batches:
                for t1, t2, text, todo in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    text = text.encode("utf-8")
                    for r in todo:
                        raw = text[r["lo"] : r["lo"] + r["n"] - 1 + depth]
                        for side, core, part, lo, place in _extended(raw, r["lo"], r["at"], gram, depth, b""):
                            yield side, core, t1, t2, lo, place, not r["whole"], part

        return _core_batches(rows())

    def next_digit(batches):
        def rows():
            for batch in batches:
                for side, core, t1, t2, lo, place, ask, raw in zip(*(batch.column(c).to_pylist() for c in range(8))):
                    for s, longer, part, first, at in _extended(raw, lo, place, len(core), depth, side):
                        yield s, longer, t1, t2, first, at, ask, part

        return _core_batches(rows())

    pieces = found.select("t1", "t2", F.inline(F.filter("runs", lambda r: r["whole"]))).select("t1", "t2", "lo", "n")
    digit = F.xxhash64("side", "core")
    rows = texts.join(left, ["t1", "t2"]).select("t1", "t2", "text", "runs").mapInArrow(lean(second_digit), CORES)
    while True:
        rows = persisted(rows, "cores")
        sums = rows.groupBy(digit.alias("h")).agg(F.sum(F.octet_length("raw")).alias("size"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        many = bloom(sums.where(F.col("size") > BUFFER).select("h"))
        large = many.test(digit) if many.filled else F.lit(False)
        small = rows.where(~large).repartition("side", "core").sortWithinPartitions("side", "core")
        pieces = pieces.unionAll(persisted(small.mapInArrow(lean(lambda batches: _compared(batches, depth)), "t1 long, t2 long, lo long, n int"), "windows"))
        if not many.filled:
            break
        # cores that are whole windows: all of a group are equal, so every one of a group of two or more is repeated
        ready = F.octet_length("core") == depth
        done = rows.where(large & ready)
        equal = done.groupBy("side", "core").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("side", "core")
        pieces = pieces.unionAll(persisted(done.where("ask").join(equal, ["side", "core"], "left_semi").select("t1", "t2", "lo", F.lit(1).alias("n")), "windows"))
        rows = rows.where(large & ~ready).mapInArrow(lean(next_digit), CORES)
    return persisted(pieces.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "n")).alias("runs")), "repeated")


def _with_runs(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """keyed with the runs of its texts. Texts that surely have none don't go through the shuffle of the join."""
    some = maybe_in(runs.select("t1"))("t1")
    without = keyed.where(~some).withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    return keyed.where(some).join(runs, ["t1", "t2"], "left").select(without.columns).unionAll(without)


def removals(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the kept bytes, for each row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            out = []
            for raw, todo in zip(batch.column(1), batch.column(2)):
                raw = raw.as_py().encode("utf-8")
                a, b = _merged([(r["lo"], r["n"]) for r in todo.as_py() or ()], depth, len(raw))
                kept, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.update(raw[at:x])
                    at = y
                kept.update(raw[at:])
                out.append((len(raw), int((b - a).sum()), len(a), kept.hexdigest()))
            n, r, s, k = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (n, r, s)), pa.array(k, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = _keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return (
        _with_runs(keyed, repeated(docs, depth, gram))
        .select("doc_id", "text", "runs")
        .mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def cleaned(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes taken out of text; all other columns stay as they are.

    A character of which only some bytes repeat stays. Rows whose whole text goes are dropped; rows that had none stay.
    """

    def run(batches):
        for batch in batches:
            out = []
            for raw, todo in zip(batch.column(at), batch.column(len(names))):
                text, todo = raw.as_py(), todo.as_py()
                if todo:
                    raw = text.encode("utf-8")
                    parts, last = [], 0
                    for x, y in zip(*(v.tolist() for v in _merged([(r["lo"], r["n"]) for r in todo], depth, len(raw)))):
                        while x < y and raw[x] & 0xC0 == 0x80:
                            x += 1
                        while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                            y -= 1
                        parts.append(raw[last:x])
                        last = y
                    text = b"".join([*parts, raw[last:]]).decode("utf-8")
                out.append((text, not (todo and not text)))
            texts, keep = zip(*out) if out else ((), ())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    names, at = docs.columns, docs.columns.index("text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(c) for c in names])
    keyed = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), row.alias("row"))
    joined = _with_runs(keyed, repeated(docs, depth, gram))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("runs").alias("_runs")).mapInArrow(lean(run), docs.schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
