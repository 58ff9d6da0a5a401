"""Vector code compression: product codes whose codebooks are refined by Hamerly's form of Lloyd's iteration.

Components become integers (floor of SCALE times the value) and vectors are cut into equal parts. Each part position has
a codebook of at most ENTRIES entries, begun as the parts of the vectors of smallest id. A round assigns every part to
its nearest entry and replaces each entry by the componentwise floor of its parts' mean.

What a round knows about a part is written with it: its entry, an upper bound of its distance to that entry, and one
lower bound of its distance to the second-nearest. When entries move, the upper bound grows by the way of its own entry
and the lower one shrinks by the longest way of another. While the upper bound stays strictly below the lower one (or below half
the way to the entry's nearest neighbour), no other entry can be as near, and the part keeps its entry unseen. Else its
own distance is computed, and if that doesn't help, all distances, in integers. Bounds are rounded outwards, and a tie is
no strict inequality, so ties always come to a full scan, which takes the lower index.

A round is one pass without shuffle: a task reads vectors with their state, writes them with their new state, and adds
to the same table its own sums of parts for each entry, so only these few rows are aggregated (at most parts x
entries), and a task that is run again writes both anew. Tables go to the shared folder. Labels' errors are summed
before they are shuffled; the HEAVY most frequent labels are joined as a broadcast table of that many rows, others by a shuffle.

Vectors that are null, empty or hold null or non-finite components take no part; nor do vectors of another dimension than
the most frequent one (the smaller, if tied). Where parts doesn't divide the dimension, parts differ by one component.
Integers saturate so that a sum of squared distances still fits a long: at 64 components, at values beyond 700,000. Rows are coded one by one, so
repeated rows have equal codes; null ids come after all others when codebooks begin, and rows that repeat an id go by
their vectors there. Labels may be null (one group). A sum over a label that leaves the range of a long stays at its end.
An empty table gives an empty table; columns besides the three are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches, persisted

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
HEAVY = 1024
LONG = 2**63 - 1
OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def _sqrt_up(d: np.ndarray) -> np.ndarray:
    """Single-precision numbers not below the roots of integers."""
    return np.nextafter(np.nextafter(np.sqrt(d.astype(np.float64)), np.inf).astype(np.float32), np.float32(np.inf))


def _sqrt_down(d: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(d.astype(np.float64)), -np.inf).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def largest_component(dim: int) -> int:
    """Components are held within this, so that no vector's squared distance leaves a long."""
    return int((LONG / dim) ** 0.5 / 2) - 1


def integers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * v) of finite doubles, held within largest_component."""
    most = largest_component(v.shape[1])
    return np.floor(np.clip(v, -(most // scale), most // scale) * scale).astype(np.int64)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parts x (n x d) and entries: nearest entry (lower index at ties), its squared distance, the second smallest one."""
    n, d = x.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if d * (2 * most) ** 2 < 1 << 53:  # all intermediate values are integers that doubles hold exactly
        f, b = x.astype(np.float64), book.astype(np.float64)
        dist = ((f * f).sum(1)[:, None] - 2 * (f @ b.T) + (b * b).sum(1)).astype(np.int64)
    else:
        dist = np.stack([((x - e) ** 2).sum(1) for e in book], 1)
    near = dist.argmin(1)
    rows = np.arange(n)
    best = dist[rows, near]
    if len(book) == 1:
        return near, best, np.full(n, LONG)
    dist[rows, near] = LONG
    return near, best, dist.min(1)


@dataclass
class Books:
    """Codebooks (one array of entries x components for each part) and how far entries moved in the last round."""

    entries: list[np.ndarray]
    moved: list[np.ndarray] | None = None  # upper bounds of the ways

    def half_gaps(self, p: int) -> np.ndarray:
        """Lower bounds of half the distance from each entry to the nearest other one."""
        book = self.entries[p]
        if len(book) < 2:
            return np.full(len(book), np.inf, np.float32)
        d = np.stack([((book - e) ** 2).sum(1) for e in book])
        d[np.arange(len(book)), np.arange(len(book))] = LONG
        return _sqrt_down(d.min(1)) * np.float32(0.5)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.entries for e in book for v in e.tolist()).encode()).hexdigest()


@dataclass
class State:
    """Entries and bounds of vectors' parts (n x parts each)."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: int = 0


def assign(cuts: list[int], q: np.ndarray, books: Books, old: State | None) -> State:
    """The nearest entry of every part of the integer vectors q, from the state that the last round left."""
    n, parts = len(q), len(books.entries)
    new = State(np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32))
    up, down = np.float32(np.inf), np.float32(-np.inf)
    for p, book in enumerate(books.entries):
        x = q[:, cuts[p] : cuts[p + 1]]
        if old is None:
            left = np.arange(n)
        else:
            code, moved = old.code[:, p], books.moved[p]
            # the way of another entry: the longest one, or the second longest where the own entry has gone the longest
            order = np.argsort(-moved, kind="stable")
            others = np.where(code == order[0], moved[order[1]] if len(moved) > 1 else np.float32(0), moved[order[0]])
            upper = np.nextafter(old.upper[:, p] + moved[code], up)
            lower = np.maximum(np.nextafter(old.lower[:, p] - others, down), books.half_gaps(p)[code])
            left = np.flatnonzero(~(upper < lower))
            upper[left] = _sqrt_up(((x[left] - book[code[left]]) ** 2).sum(1))
            left = left[~(upper[left] < lower[left])]
            new.code[:, p], new.upper[:, p] = code, upper
            new.lower[:, p] = np.nextafter(old.lower[:, p] - others, down)
        near, best, second = scan(x[left], book)
        new.code[left, p], new.upper[left, p], new.lower[left, p] = near, _sqrt_up(best), _sqrt_down(second)
        new.scanned += len(left)
    return new


def _sums(cuts, q, code, entries: int):
    """Count and componentwise sum of the parts of each (part, entry) that has any."""
    for p in range(len(cuts) - 1):
        total, count = np.zeros((entries, cuts[p + 1] - cuts[p]), np.int64), np.bincount(code[:, p], minlength=entries)
        np.add.at(total, code[:, p], q[:, cuts[p] : cuts[p + 1]])
        for e in np.flatnonzero(count):
            yield p, int(e), int(count[e]), total[e]


def _rows(column, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


class Coder:
    """Codes of vectors(vec_id, embedding, label), and the codebooks that they were made with."""

    def __init__(self, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
        if not 0 < entries <= 256:
            raise ValueError("a code is one byte: 1 to 256 entries")
        self.parts, self.most, self.scale = parts, entries, scale
        self.books = self.table = None
        bounded_batches(vectors.sparkSession)
        bad = F.exists("v", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
        usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
        usable = usable.where((F.size("v") > 0) & ~bad)
        dims = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        if dims is None:
            return
        self.dim = dims["dim"]
        self.cuts = [p * self.dim // parts for p in range(parts + 1)]
        self.table = usable.where(F.size("v") == self.dim).withColumnRenamed("v", "q")
        self.fresh = True  # the table holds vectors as they came, without state
        first = np.array([r.q for r in self.table.select("q", "vec_id").orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()], np.float64)
        first = integers(first, scale)
        self.books = Books([first[:, a:b] for a, b in zip(self.cuts, self.cuts[1:])])
        for i in range(rounds):
            self._round(i)

    def _read(self, batch):
        """Integer vectors and their state, from a batch of the table: q, then code, upper and lower once there are."""
        if self.fresh:
            return integers(_rows(batch.column(0), self.dim, np.float64), self.scale), None
        q = _rows(batch.column(0), self.dim, np.int64)
        code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, self.parts)
        return q, State(code, *(_rows(batch.column(i), self.parts, np.float32) for i in (2, 3)))

    def _state_columns(self):
        return ["q"] if self.fresh else ["q", "code", "upper", "lower"]

    def __getstate__(self):  # what tasks need
        return {k: getattr(self, k) for k in ("parts", "most", "scale", "books", "dim", "cuts", "fresh")}

    def _round(self, i: int) -> None:
        label = self.table.schema["label"].dataType
        coder, kinds = self, pa.list_(pa.float32())
        names = ["q", "code", "upper", "lower", "part", "entry", "n", "sums"]

        def run(batches):
            totals: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
            kept = None
            for batch in batches:
                kept = [(f.name, f.type) for f in batch.schema][-2:]
                if not batch.num_rows:
                    continue
                q, old = coder._read(batch)
                new = assign(coder.cuts, q, coder.books, old)
                for p, e, n, total in _sums(coder.cuts, q, new.code, coder.most):
                    m, before = totals.get((p, e), (0, 0))
                    totals[p, e] = m + n, before + total
                lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel(), kind))
                columns = [lists(q.astype(np.int32), pa.int32()), pa.array([c.tobytes() for c in new.code], pa.binary()), lists(new.upper, pa.float32()), lists(new.lower, pa.float32())]
                nulls = [pa.nulls(len(q), k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *nulls, *batch.columns[-2:]], [*names, *(name for name, _ in kept)])
            if totals:
                (p, e), (n, total) = zip(*totals), zip(*totals.values())
                size = len(p)
                columns = [pa.nulls(size, pa.list_(pa.int32())), pa.nulls(size, pa.binary()), pa.nulls(size, kinds), pa.nulls(size, kinds)]
                sums = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), pa.array([t.tolist() for t in total], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *sums, *(pa.nulls(size, k) for _, k in kept)], [*names, *(name for name, _ in kept)])

        schema = f"q array<int>, code binary, upper array<float>, lower array<float>, part int, entry int, n long, sums array<long>, vec_id long, label {label.simpleString()}"
        written = persisted(self.table.select(*self._state_columns(), "vec_id", "label").mapInArrow(run, schema), f"codes{i}")
        one = written.where("part is not null")
        # wide sums: a hot entry may have any number of parts
        sums = one.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = [b.copy() for b in self.books.entries]
        for r in sums.collect():  # one row for each component of a codebook
            books[r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]
        moved = [_sqrt_up(((a - b) ** 2).sum(1)) for a, b in zip(books, self.books.entries)]
        self.books, self.fresh = Books(books, moved), False
        self.table = written.where("part is null").select("q", "code", "upper", "lower", "vec_id", "label")

    def codes(self) -> DataFrame:
        """vec_id, label, code (bytes), error of every vector, by the final codebooks."""
        coder = self

        def run(batches):
            for batch in batches:
                q, old = coder._read(batch) if batch.num_rows else (np.zeros((0, coder.dim), np.int64), None)
                code = assign(coder.cuts, q, coder.books, old).code
                error = np.zeros(len(q), np.int64)
                for p, book in enumerate(coder.books.entries):
                    error += ((q[:, coder.cuts[p] : coder.cuts[p + 1]] - book[code[:, p]]) ** 2).sum(1)
                columns = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), *batch.columns[-2:]]
                yield pa.RecordBatch.from_arrays(columns, ["code", "error", *batch.schema.names[-2:]])

        label = self.table.schema["label"].dataType.simpleString()
        return self.table.select(*self._state_columns(), "vec_id", "label").mapInArrow(run, f"code binary, error long, vec_id long, label {label}")


def with_group_sum(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows with the sum of value over equal keys (nulls together), held within a long; no key's rows meet in one task."""
    total = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(LONG)).cast("long")
    sums = persisted(rows.groupBy(key).agg(total.alias(out), F.count(F.lit(1)).alias("_n")), "sums")
    heavy = sums.orderBy(F.desc("_n"), key).limit(HEAVY).select(F.col(key).alias("_key"), F.col(out).alias("_heavy"), F.lit(True).alias("_is"))
    marked = rows.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    if sums.count() <= HEAVY:
        return marked.withColumnRenamed("_heavy", out).drop("_is")
    rest = sums.select(F.col(key).alias("_key"), out)
    light = marked.where("_is is null").drop("_heavy", "_is").join(rest, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return marked.where("_is").withColumnRenamed("_heavy", out).drop("_is").unionByName(light)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for vectors(vec_id, embedding, label)."""
    coder = Coder(vectors, parts, entries, rounds, scale)
    if coder.table is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    coded = with_group_sum(persisted(coder.codes(), "coded"), "label", "error", "label_error")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(coder.books.sha256()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(rounds: int = ROUNDS) -> str:
    """Lloyd's rounds as common table expressions."""
    steps = [
        f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {SCALE}) as bigint)) as q,
         row_number() over (order by vec_id nulls last, embedding) as r
  from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
part as materialized (
  select r, p, q[p * (len(q) // {PARTS}) + 1:(p + 1) * (len(q) // {PARTS})] as v from kept, range({PARTS}) t(p)
),
book0 as materialized (select p, cast(r - 1 as bigint) as e, v from part where r <= {ENTRIES})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} as materialized (
  select r, p, min(struct_pack(d := list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) as best
  from part a join book{i} b using (p) group by r, p
)""")
        if i < rounds:
            steps.append(f"""
sum{i} as (
  select p, e, i, cast(sum(x) as bigint) as s, count(*) as n
  from (select p, best.e as e, unnest(v) as x, generate_subscripts(v, 1) as i from near{i} join part using (r, p)) group by p, e, i
),
book{i + 1} as materialized (
  select p, e, coalesce(m.v, b.v) as v
  from book{i} b left join (select p, e, list((s - ((s % n) + n) % n) // n order by i) as v from sum{i} group by p, e) m using (p, e)
)""")
    last = f"""
coded as (
  select r, string_agg(printf('%02x', cast(best.e as integer)), '' order by p) as code, cast(sum(best.d) as bigint) as error from near{rounds} group by r
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book{rounds}) as codebooks_sha256
from coded join kept using (r)
"""
    return ",".join([*steps, last])


OP13_SQL = _sql()
