"""Approximate nearest neighbours over robust-pruned directed graphs, one graph per shard.

Equal vectors are collapsed first: of each distinct vector only the K + 1 smallest ids can ever be among a query's K
nearest, and a window group limit keeps just these before the shuffle, so groups of copies cost nothing.

Distinct vectors are dealt to groups by two things: bands of their norm, each RATIO wide and counted down from the
largest one (the last of BANDS holds all that is left), so that few large vectors stand apart however heavy the tail is; and cells, the
nearest of a few routing directions fitted on a bounded sample (SAMPLE vectors), as many as a band's size asks for. A group of more
than shard_rows vectors is split further by a hash, so a crowded cell is no hot shard. Within a shard one more component
fills every vector up to the largest norm; queries have zero there. So all points lie on a sphere, and the nearest to a
query's direction is the one of largest inner product. Searches begin at STARTS random points and at the longest vectors. Every shard builds its
graph over directions, and where norms differ it joins to each point's edges those of a second one over the sphere, since either alone misses
answers (directions where all are alike, the sphere where they are spread). Points are inserted in batches: a greedy beam search
over the graph so far proposes neighbours, and relaxed distance pruning keeps of these the diverse ones (a candidate goes
when a kept neighbour is ALPHA times nearer to it than the point is). Points that pruning leaves without a way to them get one
more edge from their nearest neighbour that has a way. What beam search finds is ranked by the inner
product of the original vectors, in double precision.

Queries visit groups in the order of what they promise: their largest norm times the cosine to their centre, less their spread. How many is measured in each run, not assumed:
CALIBRATION queries are answered exactly against all rows, and every query visits as many groups as hold COVER of those
answers, and more until these hold K vectors besides its own: one rule for tables of every size. Where data have no structure (independent random directions),
that is nearly all of them: the stated query set then passes every shard once, in blocks.

Partitions are sorted so that a shard's vectors come first and the queries follow, block by block: a task holds one
shard and one block. Each shard answers a query with its K best, and answers from all shards are merged by rank, with
a group limit before the shuffle.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or candidates; nor
do null ids, nor vectors of another dimension than the most frequent one of the table (the smaller, if tied). Rows that
repeat an id and vector count once; an id with several vectors is one query with the answers of all. Columns besides the
id and the vector are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import persisted

K = 20
SHARD_ROWS = 16_384
LEAST_SHARDS = 8
BANDS, RATIO = 64, 1.2  # bands of norm, and how far norms in one differ
SAMPLE, MAX_CELLS = 8192, 256
CALIBRATION, COVER = 128, 0.99
DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA = 40, 64, 160, 1.2
ALIKE = 0.2  # last component on a shard's sphere up to which its directions alone say what is near (norms within 2 %)
STARTS = 256  # points of a shard at which searches begin: enough to stand in most of its clusters
ENTRIES = 32  # longest vectors of a shard at which searches begin, too
BEAM_SHARE = 64  # the beam holds at least this part of a shard
BLOCK = 512
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _beam_search(x, graph, queries, entry, width):
    """Ids and squared distances of the width nearest points that greedy search meets, nearest first, for each query."""
    nq, n = len(queries), len(x)
    width = min(width, n)
    norm = (x * x).sum(1)
    ids = np.full((nq, width), n, np.int32)
    dist = np.full((nq, width), np.inf, np.float32)
    open_ = np.zeros((nq, width), bool)
    seen = np.zeros((nq, n + 1), bool)
    seen[:, n] = True
    k = min(len(entry), width)
    first = norm[entry] - 2 * queries @ x[entry].T
    near = np.argpartition(first, k - 1, axis=1)[:, :k]
    ids[:, :k] = entry[near]
    dist[:, :k] = np.take_along_axis(first, near, 1)
    open_[:, :k] = True
    seen[:, entry] = True
    live = np.arange(nq)
    expand = 4
    while len(live):
        d = np.where(open_[live], dist[live], np.inf)
        pick = np.argpartition(d, min(expand, width - 1), axis=1)[:, :expand]
        ok = np.take_along_axis(d, pick, 1) < np.inf
        go = ok.any(1)
        live, pick, ok = live[go], pick[go], ok[go]
        if not len(live):
            break
        at = np.where(ok, np.take_along_axis(ids[live], pick, 1), n)
        open_[live[:, None], pick] = False
        new = graph[at].reshape(len(live), -1)
        new = np.where(seen[live[:, None], new], n, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        seen[live[:, None], new] = True
        r, c = np.nonzero(new < n)
        nd = np.full(new.shape, np.inf, np.float32)
        p = new[r, c]
        nd[r, c] = norm[p] - 2 * np.einsum("ij,ij->i", queries[live[r]], x[p])
        all_d = np.concatenate([dist[live], nd], 1)
        all_i = np.concatenate([ids[live], new], 1)
        all_o = np.concatenate([open_[live], new < n], 1)
        top = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[live], ids[live], open_[live] = (np.take_along_axis(y, top, 1) for y in (all_d, all_i, all_o))
    order = np.argsort(dist, axis=1, kind="stable")
    dist = np.take_along_axis(dist, order, 1) + (queries * queries).sum(1)[:, None]
    return np.take_along_axis(ids, order, 1), dist


def _prune(x, points, cand, alpha=ALPHA, degree=DEGREE):
    """Robust pruning: of each point's candidates (n where none), the diverse nearest ones, up to degree."""
    n = len(x) - 1  # the last row stands for "none"
    m, c = cand.shape
    v = x[cand]
    d = ((v - x[points][:, None]) ** 2).sum(2)
    d[(cand == n) | (cand == points[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, cand = np.take_along_axis(d, order, 1), np.take_along_axis(cand, order, 1)
    v = x[cand]
    sq = (v * v).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((m, degree), n, np.int32)
    filled = np.zeros(m, int)
    rows = np.arange(m)
    for _ in range(degree):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        out[rows[has], filled[has]] = cand[rows[has], first[has]]
        filled[has] += 1
        near = between[rows, first]
        alive &= ~((alpha * alpha * near <= d) & has[:, None])
        alive[rows[has], first[has]] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7):
    """Directed graph (a row of edges for each point, n where there is none) and the entry points."""
    n = len(x)
    pad = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    graph = np.full((n + 1, degree), n, np.int32)
    if n == 1:
        return graph, np.zeros(1, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    start = min(n, STARTS)
    entry = first = order[:start]
    for lo in range(0, start, 32):
        some = first[lo : lo + 32]
        graph[some] = _prune(pad, some, np.repeat(first[None], len(some), 0), degree=degree)
    done = start
    while done < n:
        new = order[done : done + min(BLOCK, done)]
        cand, _ = _beam_search(pad[:n], graph, x[new], entry, beam)
        graph[new] = _prune(pad, new, cand, degree=degree)
        # back edges; a point that gets more than it has room for is pruned anew
        a = np.repeat(new, degree)
        b = graph[new].ravel()
        a, b = a[b < n], b[b < n]
        s = np.argsort(b, kind="stable")
        a, b = a[s], b[s]
        to, at, count = np.unique(b, return_index=True, return_counts=True)
        for lo in range(0, len(to), BLOCK):
            t, f, c = to[lo : lo + BLOCK], at[lo : lo + BLOCK], count[lo : lo + BLOCK]
            old = graph[t]
            room = np.full((len(t), int(c.max())), n, np.int32)
            col = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            room[np.repeat(np.arange(len(t)), c), col] = a[np.repeat(f, c) + col]
            both = np.concatenate([old, room], 1)
            full = ((both < n).sum(1)) > degree
            if full.any():
                graph[t[full]] = _prune(pad, t[full], both[full], degree=degree)
            if (~full).any():
                both[~full] = np.sort(both[~full], axis=1)
                graph[t[~full]] = both[~full][:, :degree]
        done += len(new)
    return _reachable(pad, graph, entry), entry


def _reachable(pad: np.ndarray, graph: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The graph with further edges, so that every point can be reached from the entry points.

    Back edges that were pruned leave some points without any way to them; each gets one from the nearest of its own
    neighbours that has one.
    """
    n = len(graph) - 1
    seen = np.zeros(n + 1, bool)
    seen[n] = True
    frontier, source, target = np.asarray(entry), [], []
    while True:
        while len(frontier):
            seen[frontier] = True
            frontier = np.unique(graph[frontier])
            frontier = frontier[~seen[frontier]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        near = graph[lost]
        far = ((pad[near] - pad[lost][:, None]) ** 2).sum(2)
        far[~seen[near] | (near == n)] = np.inf
        best, ok = far.argmin(1), np.isfinite(far.min(1))
        if ok.any():
            source.append(near[ok, best[ok]])
            frontier = lost[ok]
        else:
            source.append(entry[:1])
            frontier = lost[:1]
        target.append(frontier)
    if not source:
        return graph
    a, b = np.concatenate(source), np.concatenate(target)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    slot = np.arange(len(a)) - np.searchsorted(a, a)
    more = np.full((n + 1, int(slot.max()) + 1), n, np.int32)
    more[a, slot] = b
    return np.concatenate([graph, more], axis=1)


def _directions(v: np.ndarray) -> np.ndarray:
    """Rows of unit length, whatever the size of their components."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """A list column of numbers as rows of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), kind))


def routing_cells(sample: np.ndarray, cells: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    """Directions of `cells` clusters of a sample of directions (spherical k-means)."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, nearest, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(length > 0, total / np.maximum(length, 1e-30), centre)
    return centre


def lifted(v: np.ndarray) -> np.ndarray:
    """Vectors over the largest norm among them, with one more component that gives them all the same length."""
    v = v / np.abs(v).max()
    v = v / np.linalg.norm(v, axis=1).max()
    return np.column_stack([v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1)))])


class Router:
    """Groups (band of norm, cell) of vectors, and the order in which a query visits them. Its size is bounded."""

    def __init__(self, top: float, sizes: dict[int, int], rows: int, sample: np.ndarray):
        """sizes: vectors of each band that has any; rows: vectors that a cell should hold."""
        self.top = top
        wanted = {b: min(MAX_CELLS, 1 << max(0, (-(-n // rows) - 1)).bit_length()) for b, n in sizes.items()}
        self.centres = {c: routing_cells(sample, c) for c in sorted(set(wanted.values()))}
        self.bands, self.first, self.groups = {}, {}, 0
        for b in sorted(sizes):
            self.bands[b], self.first[b] = wanted[b], self.groups
            self.groups += len(self.centres[wanted[b]])
        self.most = np.zeros(self.groups)  # largest norm of each group, 0 for an empty one
        self.spread = np.zeros(self.groups)  # angle between a group's centre and its vectors, by their mean cosine
        self.size = np.zeros(self.groups, np.int64)
        self.shards = np.zeros(self.groups, np.int64)
        self.probes = self.groups

    def near(self, v: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each vector, and the cosine to its centre."""
        u, group, cosine = _directions(v), np.zeros(len(v), np.int64), np.zeros(len(v))
        for b, cells in self.bands.items():
            at = np.flatnonzero(band == b)
            if len(at):
                by = u[at] @ self.centres[cells].T
                best = by.argmax(1)
                group[at], cosine[at] = self.first[b] + best, by[np.arange(len(at)), best]
        return group, cosine

    def group(self, v: np.ndarray, band: np.ndarray) -> np.ndarray:
        return self.near(v, band)[0]

    def order(self, v: np.ndarray) -> np.ndarray:
        """Per query its groups that hold vectors, the most promising first; the others come last.

        A group promises its largest norm, times the cosine to its centre turned towards the query by the group's spread.
        """
        u = _directions(v)
        angle = {c: np.arccos(np.clip(u @ centre.T, -1, 1)) for c, centre in self.centres.items()}
        angle = np.concatenate([angle[cells] for cells in self.bands.values()], axis=1)
        promise = np.cos(np.maximum(0.0, angle - self.spread)) * self.most
        return np.argsort(np.where(self.most > 0, -promise, np.inf), axis=1, kind="stable")

    def visits(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries and groups that they visit: the first `probes` of each one's order, and more until they hold k vectors besides its own."""
        order = self.order(v)[:, : max(self.probes, k + 1)]
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        query, place = np.nonzero((np.arange(order.shape[1]) < self.probes) | (before <= k))
        return query, order[query, place]


def _shard(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's points on the sphere, its graph and where searches begin."""
    x = lifted(vectors.astype(np.float64)).astype(np.float32)
    flat = np.column_stack([_directions(vectors.astype(np.float64)), np.zeros(len(x))]).astype(np.float32)
    graph, entry = build_graph(flat)
    if x[:, -1].max() > ALIKE:
        graph = np.concatenate([graph, build_graph(x)[0]], axis=1)
    return x, graph, np.union1d(entry, np.argsort(x[:, -1], kind="stable")[:ENTRIES])


def _search_shard(vectors, members, queries, query_ids, state, k, beam):
    """The k best ids of one shard for a block of queries: query ids, ids, scores."""
    x, graph, entry = state
    asked = np.column_stack([_directions(queries), np.zeros(len(queries))]).astype(np.float32)
    found, _ = _beam_search(x, graph, asked, entry, max(beam, len(x) // BEAM_SHARE))
    n = len(x)
    r, c = np.nonzero(found < n)
    p = found[r, c]
    score = np.einsum("ij,ij->i", queries[r], vectors[p].astype(np.float64))
    sizes = members[1][p + 1] - members[1][p]
    col = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids = members[0][np.repeat(members[1][p], sizes) + col]
    r, score = np.repeat(r, sizes), np.repeat(score, sizes)
    keep = ids != query_ids[r]
    r, ids, score = r[keep], ids[keep], score[keep]
    order = np.lexsort((ids, -score, r))
    r, ids, score = r[order], ids[order], score[order]
    count = np.bincount(r, minlength=len(queries))
    rank = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
    keep = rank < k
    return query_ids[r[keep]], ids[keep], score[keep]


def _calibrated(points: DataFrame, queries: DataFrame, router: Router, dim: int, k: int) -> int:
    """How many groups hold COVER of the k nearest of a bounded set of queries, which are found exactly, over all points but the query's own."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).select("v", F.xxhash64("v").alias("h")).collect()
    if not some:
        return 1
    asked, own = np.array([r.v for r in some], np.float64), np.array([r.h for r in some])[:, None]

    def run(batches):
        best, of = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0), dim)
                score = np.concatenate([best, np.where(own == batch.column(2).to_numpy(), -np.inf, asked @ v.T)], axis=1)
                group = np.concatenate([of, np.tile(router.group(v, batch.column(1).to_numpy()), (len(asked), 1))], axis=1)
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                best, of = np.take_along_axis(score, top, 1), np.take_along_axis(group, top, 1)
        q, c = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, c]), pa.array(of[q, c])], ["q", "score", "group"])

    found = points.select("v", "band", "h").mapInArrow(run, "q long, score double, group long")
    first = Window.partitionBy("q").orderBy(F.desc("score"))
    nearest = found.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k).select("q", "group").collect()  # CALIBRATION * k rows
    if not nearest:
        return 1
    place = np.argsort(router.order(asked), axis=1)
    needed = np.sort([place[r.q, r.group] for r in nearest]) + 1
    return int(needed[max(0, int(np.ceil(COVER * len(needed))) - 1)])


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM, probes: int | None = None
) -> DataFrame:
    """The k nearest of vectors(vec_id, embedding) for each row of queries(vec_id, embedding), by inner product.

    probes sets how many groups a query visits at least; by default that is calibrated, see above.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    column = F.col("embedding").cast(f"array<{kind}>")

    def usable(df, dim):
        bad = F.exists("v", lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
        kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), column.alias("v"))
        return kept.where(F.col("vec_id").isNotNull() & (F.size("v") == dim) & ~bad & F.exists("v", lambda y: y != 0))

    out = "query_id long, rank int, vec_id long, score double"
    size = F.size("embedding").alias("dim")
    most = vectors.where(F.size("embedding") > 0).groupBy(size).count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return spark.createDataFrame([], out)
    dim = most["dim"]
    copies = Window.partitionBy("v").orderBy("vec_id")
    length = F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    points = (
        usable(vectors, dim)
        .withColumn("n", F.dense_rank().over(copies))
        .where(F.col("n") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))  # k + 1 ids at most
    )
    points = persisted(points.select("ids", "v", F.sqrt(length).alias("norm"), F.xxhash64("v").alias("h")), "points")
    asked = usable(queries, dim).distinct()
    top = points.agg(F.max("norm")).first()[0]
    if top is None:
        return spark.createDataFrame([], out)
    points = points.withColumn("band", F.least(F.lit(BANDS - 1), F.floor(F.log(RATIO, F.lit(top) / F.col("norm")) + 1e-9)).cast("int"))

    held = {r.band: r.n for r in points.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # BANDS rows at most
    rows = max(1, min(shard_rows, sum(held.values()) // LEAST_SHARDS))
    sample = points.orderBy("h").limit(SAMPLE).select("v").collect()
    router = Router(top, held, rows, _directions(np.array([r.v for r in sample], np.float64)))

    def grouped(batches):
        for batch in batches:
            if batch.num_rows:
                group, cosine = router.near(_matrix(batch.column(0), dim), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), batch.column(2), pa.array(cosine)], ["group", "norm", "cosine"])

    sizes = points.select("v", "band", "norm").mapInArrow(grouped, "group int, norm double, cosine double").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.avg("cosine").alias("cosine"))
    for r in sizes.collect():  # BANDS * MAX_CELLS rows at most
        router.size[r.group], router.shards[r.group], router.most[r.group], router.spread[r.group] = r.n, -(-r.n // shard_rows), r.most, np.arccos(np.clip(r.cosine, -1, 1))
    held = int((router.most > 0).sum())
    router.probes = min(held, probes or _calibrated(points, asked, router, dim, k))
    first_shard = np.cumsum(router.shards) - router.shards
    shards = int(router.shards.sum())
    element = pa.float32() if kind == "float" else pa.float64()

    def place(batches):
        for batch in batches:
            group = router.group(_matrix(batch.column(1), dim), batch.column(2).to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            shard = first_shard[group] + batch.column(3).to_numpy() % router.shards[group]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.zeros(len(shard)), pa.int32()), batch.column(0), batch.column(1)], ["shard", "kind", "ids", "v"])

    def route(batches):
        """One row for each shard that a block of queries visits: their ids and their vectors, one after the other."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 8 * BLOCK):
                part = batch.slice(lo, 8 * BLOCK)
                ids, flat = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                query, group = router.visits(_matrix(part.column(1), dim), k)
                by = np.argsort(group, kind="stable")
                query, group = query[by], group[by]
                at = np.flatnonzero(np.diff(group, prepend=-1))
                for a, b in zip(at, [*at[1:], len(group)]):
                    q = query[a:b]
                    for s in range(router.shards[group[a]]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([first_shard[group[a]] + s], pa.int32()), pa.array([1], pa.int32()), _lists([ids[q]], pa.int64()), _lists([flat[q].ravel()], element)],
                            ["shard", "kind", "ids", "v"],
                        )

    row = f"shard int, kind int, ids array<long>, v array<{kind}>"
    every = (
        points.select("ids", "v", "band", "h")
        .mapInArrow(place, row)
        .unionByName(asked.mapInArrow(route, row))
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "kind")
    )

    def run(batches):
        shard, parts, state = None, [], None
        vecs = members = None
        for batch in batches:
            s, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(s) != 0) | (np.diff(what) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(s)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if s[a] != shard:
                    shard, parts, state = s[a], [], None
                if what[a] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if state is None:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    flat = t.column(3).chunk(0)
                    vecs = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    ids = t.column(2).chunk(0)
                    count = np.diff(ids.offsets.to_numpy())
                    members = (ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(count)]))
                    state = _shard(vecs)
                for i in range(part.num_rows):
                    block = part.slice(i, 1)
                    qi, qv = block.column(2).flatten().to_numpy(), _matrix(block.column(3), dim)
                    for lo in range(0, len(qi), BLOCK):
                        got = _search_shard(vecs, members, qv[lo : lo + BLOCK], qi[lo : lo + BLOCK], state, k, beam)
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in got], schema=OUT)

    found = every.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
