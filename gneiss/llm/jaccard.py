"""N-gram Jaccard join by grouped prefixes.

A text's set holds its distinct k-word shingles (64-bit hashes). Two sets link when their Jaccard similarity reaches
the threshold, and the result is each document's component of links. Exactly: no band or candidate is capped. Sets and
prefixes are told apart by 128-bit fingerprints.

1. A count sketch of all shingles (SKETCH counters, a fixed 4 MB) gives one global order, rare shingles first, which
   keeps frequent lines and passages out of the prefixes.
2. Each text is reduced to its set's size and fingerprint, its prefix (the first n - ceil(t n) + 1 shingles in that
   order: sets that link share one of them), and a parity bitmap of about n bits. Equal sets become one node, of which
   one row is kept by a group limit before the shuffle.
3. Nodes with the same prefix and size become one group. Groups meet by prefix shingle; a group without a partner of
   fitting size is dropped there. Pairs of groups are filtered by size and by the place of the shingle in both prefixes.
4. Pairs of groups that pass are expanded to pairs of members, which are compared by bitmap: the bits in which two
   bitmaps differ are never more than the shingles in which the sets differ. A forest of the pairs that pass goes on, not
   the pairs.
5. The nodes of each candidate component are verified with their whole sets.

Frequent shingles in 4 and large components in 5 are dealt to blocks, so that no task holds more than two of them. First
each block is compared with itself and with one block of the same shingle or component, which joins what belongs to one
family; only where nodes are left apart after that do all other pairs of blocks meet. So work follows the number of
near copies, not its square, unless they really fall apart.

Nulls, empty texts and texts without words have an empty set: size 0, linked with nothing. Rows with a null id get
no component and take no part in links. Rows that repeat an id are one document each, under the same id. Component
ids are the smallest doc_id in reach. An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import maybe_in, reduced
from .graph import components
from .store import bounded_batches, persisted
from .text import WORD, chunks, lean, shingles, utf8, word_hashes

SKETCH = 1 << 20
BLOCK = 1_000_000  # shingles of a block in verification
MEMBERS = 512  # nodes of a prefix shingle that are compared in one block


def _sets(column, k):
    """Chunks of a text column as (first row, rows, shingle hashes, offsets)."""
    buf, offsets = utf8(column)
    for i, j in chunks(offsets):
        off = offsets[i : j + 1]
        h, rows = word_hashes(buf[off[0] : off[-1]], off - off[0], WORD)
        h, rows = shingles(h, rows, j - i, k)
        yield i, j, h, np.searchsorted(rows, np.arange(j - i + 1))


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of the shingles' buckets over all documents."""

    def count(total, batch):
        for _, _, h, _ in _sets(batch.column(0), k):
            total += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)

    def add(a, b):
        return np.minimum(a.astype(np.uint64) + b, 2**32 - 1).astype(np.uint32)

    return reduced(docs.select(F.col("text").cast("string")), SKETCH, np.uint32, count, add)


def _bitmap(h: np.ndarray) -> bytes:
    width = max(64, 1 << int(len(h) - 1).bit_length())
    bits = np.bincount(((h >> np.uint64(24)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _fingerprint(h: np.ndarray) -> bytes:
    """128 bits of a sequence of hashes and its length."""
    return hashlib.blake2b(np.ascontiguousarray(h), digest_size=16).digest()


def _differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the bitmaps of each pair differ, the wider one folded to the width of the other."""
    out = np.zeros(len(a), np.int64)
    wide, narrow = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for wa, wb in {*zip(wide.tolist(), narrow.tolist())}:
        at = np.flatnonzero((wide == wa) & (narrow == wb))
        x = np.frombuffer(b"".join(a[i] for i in at), np.uint64).reshape(len(at), -1)
        y = np.frombuffer(b"".join(b[i] for i in at), np.uint64).reshape(len(at), -1)
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


PAIRS = 1 << 17  # pairs of members that are expanded at a time


def _forest(token, head, n, pos, node, bitmap, percent):
    """Edges of a spanning forest of the candidate pairs among rows sorted by (token, n, head).

    Rows of one token and head are a group. Pairs of groups are filtered before their members meet.
    """
    m = len(token)
    root = np.arange(m)
    edges = []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def settled():
        nonlocal root
        while not ((r := root[root]) == root).all():
            root = r

    first = np.ones(m, bool)
    first[1:] = (token[1:] != token[:-1]) | (head[1:] != head[:-1])
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, m))
    g_token, g_n, g_pos = token[start], n[start], pos[start]
    left, d = np.arange(len(start)), 0
    while True:
        left = left[left + d < len(start)]
        j = left + d
        # sorted by size: groups from here on are larger still
        left = left[(g_token[left] == g_token[j]) & (100 * g_n[left] >= percent * g_n[j])]
        if not len(left):
            return edges
        if d and d & (d - 1) == 0:  # tokens whose rows have all met need no more comparing
            settled()
            at = np.flatnonzero(np.diff(token, prepend=token[0] - 1))
            met = np.minimum.reduceat(root, at) == np.maximum.reduceat(root, at)
            left = left[~met[np.searchsorted(at, start[left], "right") - 1]]
        j = left + d
        need = -(-percent * (g_n[left] + g_n[j]) // (100 + percent))
        fits = (np.minimum(g_n[left] - g_pos[left], g_n[j] - g_pos[j]) >= need) & ((d > 0) | (size[left] > 1))
        a, b = left[fits], j[fits]
        ends = np.cumsum(size[a] * size[b])
        done = 0
        while done < len(a):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS)))
            x, y = a[done:upto], b[done:upto]
            count = size[x] * size[y]
            k = np.repeat(np.arange(len(x)), count)
            off = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
            i, o = start[x[k]] + off // size[y[k]], start[y[k]] + off % size[y[k]]
            settled()
            keep = (root[i] != root[o]) & (node[i] != node[o]) & ((d > 0) | (i < o))
            i, o = i[keep], o[keep]
            if len(i):
                far = _differences([bitmap[v] for v in i], [bitmap[v] for v in o])
                near = far * (100 + percent) <= (n[i] + n[o]) * (100 - percent)
                for u, v in zip(i[near].tolist(), o[near].tolist()):
                    ru, rv = find(u), find(v)
                    if ru != rv:
                        root[max(ru, rv)] = min(ru, rv)
                        edges.append((u, v))
            done = upto
        d += 1


def _links(h, offsets, percent):
    """Edges (as row pairs) of a spanning forest of the links between sets."""
    m = len(offsets) - 1
    size = np.diff(offsets)
    _, flat = np.unique(h, return_inverse=True)
    member = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    todo = np.flatnonzero(size > 0)
    edges = []
    owner = np.repeat(np.arange(m), size)
    alive = np.zeros(m, bool)
    alive[todo] = True
    live_flat, live_owner = flat, owner
    for seed in todo:
        if not alive[seed]:
            continue
        alive[seed] = False
        queue = [int(seed)]
        while queue:
            x = queue.pop()
            keep = alive[live_owner]
            if keep.sum() * 2 < len(keep):
                live_flat, live_owner = live_flat[keep], live_owner[keep]
            mine = flat[offsets[x] : offsets[x + 1]]
            member[mine] = True
            both = np.bincount(live_owner[member[live_flat]], minlength=m)
            member[mine] = False
            hit = np.flatnonzero(alive & (100 * both >= percent * (size + size[x] - both)))
            alive[hit] = False
            edges += [(x, int(y)) for y in hit]
            queue += hit.tolist()
    return edges


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = spark.sparkContext.broadcast(sketch(docs, k))  # SKETCH counters, whatever the input

    def reduce(batches):
        rank = order.value
        for batch in batches:
            for i, j, h, at in _sets(batch.column(1), k):
                pos = rank[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
                rows = np.repeat(np.arange(j - i), np.diff(at))
                by = np.lexsort((h, pos, rows))
                first = h[by].view(np.int64)
                n = np.diff(at)
                take = np.where(n > 0, n + (-percent * n) // 100 + 1, 0)
                cut = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(take, n)
                prefix = first[cut]
                ends = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                sets = [h[at[r] : at[r + 1]] for r in range(j - i)]
                head = [_fingerprint(prefix[ends[r] : ends[r + 1]]) for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array([_fingerprint(s) for s in sets], pa.binary()),
                        pa.array(head, pa.binary()), pa.array([_bitmap(s) if len(s) else b"" for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix)),
                    ],
                    ["doc_id", "n", "node", "head", "bitmap", "prefix"],
                )

    every = persisted(docs.mapInArrow(lean(reduce), "doc_id long, n long, node binary, head binary, bitmap binary, prefix array<long>"), "sets")
    once = Window.partitionBy("node").orderBy("doc_id")
    nodes = every.where("n > 0 and doc_id is not null").withColumn("i", F.row_number().over(once)).where("i = 1").drop("i")

    grouped = nodes.groupBy("head", "n").agg(F.count(F.lit(1)).alias("members"), F.any_value("prefix").alias("prefix"))
    near = Window.partitionBy("token").orderBy("n")
    fits = lambda a, b: F.coalesce(100 * a >= percent * b, F.lit(False))
    tokens = (
        grouped.select("head", "n", "members", F.posexplode("prefix").alias("pos", "token"))
        .withColumn("nb", F.ceil(F.sum("members").over(Window.partitionBy("token")) / MEMBERS).cast("int"))
        .withColumn("before", F.lag("n").over(near))
        .withColumn("after", F.lead("n").over(near))
        .where(fits(F.col("before"), F.col("n")) | fits(F.col("n"), F.col("after")) | ((F.col("members") > 1) & (F.col("pos") == 0)))
        .select("token", "head", "n", "pos", "nb")
    )
    tokens = persisted(tokens, "tokens")

    def mine(nb):
        return F.pmod(F.xxhash64("node"), nb).cast("int")

    def dealt(rows, keys, first):
        """Rows with `mine` of nb blocks, once for each pair of blocks in which they meet: (x, y) beside the keys.

        At first each block meets itself and block 0; later all others.
        """
        if first:
            other = F.when(F.col("mine") == 0, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.lit(0), F.col("mine")))
        else:
            rows = rows.where("mine > 0")
            other = F.filter(F.sequence(F.lit(1), F.col("nb") - 1), lambda o: o != F.col("mine"))
        rows = rows.withColumn("other", F.explode(other)).withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
        return rows.drop("mine", "other", "nb").repartition(*keys, "x", "y")

    expanded = tokens.join(nodes.select("head", "n", "node", "bitmap"), ["head", "n"]).withColumn("mine", mine(F.col("nb")))

    def compare(batches):
        held: list[pa.RecordBatch] = []
        size, limit = 0, 1 << 15

        def flush(final):
            nonlocal held, size, limit
            t = pa.Table.from_batches(held).combine_chunks()
            keys = [t[c].to_numpy() for c in ("token", "x", "y")]
            token = np.cumsum(np.concatenate([[0], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            n, pos = t["n"].to_numpy(), t["pos"].to_numpy()
            names = t["node"].to_pylist()
            node, head = pd.factorize(pd.Series(names, dtype=object))[0], pd.factorize(pd.Series(t["head"].to_pylist(), dtype=object))[0]
            start = end = len(token)
            if not final:  # the last token may go on
                start = end = int(np.searchsorted(token, token[-1]))
                if not end:  # one token fills the buffer: only rows that can still meet larger sets stay
                    end, start = len(token), int(np.searchsorted(100 * n, percent * n[-1]))
            edges = []
            if end:
                bitmap = t["bitmap"].slice(0, end).to_pylist()
                edges = [(names[a], names[b]) for a, b in _forest(token[:end], head[:end], n[:end], pos[:end], node[:end], bitmap, percent)]
            held = t.slice(start).to_batches()
            size = len(token) - start
            limit = max(1 << 15, 2 * size)
            a, b = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= limit:
                    yield flush(False)
        if size:
            yield flush(True)

    def candidates(rows, first):
        rows = dealt(rows.select("token", "n", "head", "pos", "node", "bitmap", "nb", "mine"), ["token"], first)
        return rows.sortWithinPartitions("token", "x", "y", "n", "head").mapInArrow(lean(compare), "a binary, b binary")

    def apart(rows, key, linked):
        """The rows of those keys whose nodes have not all met; rows hold (key, node)."""
        of = rows.join(linked, "node", "left").withColumn("c_", F.coalesce("component", "node"))
        keys = of.groupBy(key).agg(F.min("c_").alias("lo"), F.max("c_").alias("hi")).where("lo <> hi").select(key)
        return rows.join(keys, key, "left_semi")

    def extended(linked, more):
        """Components of what is linked and some more edges: the ones found stand for the edges that made them."""
        return components(more.unionAll(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    maybe = components(candidates(expanded, True))
    if (tokens.agg(F.max("nb")).first()[0] or 0) > 2:  # some shingle has blocks that did not meet
        maybe = extended(maybe, candidates(apart(expanded.where("nb > 2"), "token", maybe), False))
    small = nodes.select("doc_id", "n", "node")
    total = small.join(maybe, "node").select("doc_id", "node", "n", F.col("component").alias("c"))
    total = persisted(total, "candidates")
    blocks = total.groupBy("c").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("nb"))
    placed = total.join(blocks, "c").withColumn("mine", mine(F.col("nb")))
    wanted = maybe_in(total.select("doc_id"))  # spares most other texts the shuffle; the join decides

    def held(rows, first):
        pieces = dealt(rows.select("doc_id", "node", "c", "nb", "mine"), ["c"], first)
        texts = docs.where(wanted("doc_id")).join(pieces, "doc_id").select("c", "x", "y", "node", "text")
        return texts.repartition("c", "x", "y").sortWithinPartitions("c", "x", "y").mapInArrow(lean(verify), "a binary, b binary")

    def verify(batches):
        key, nodes_, sets_, have = None, [], [], set()

        def done():
            if len(nodes_) < 2:
                return None
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets_])])
            edges = [(nodes_[a], nodes_[b]) for a, b in _links(np.concatenate(sets_), offsets, percent)]
            if not edges:
                return None
            a, b = zip(*edges)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            node = batch.column(3).to_pylist()
            for i, j, h, at in _sets(batch.column(4), k):
                for r in range(j - i):
                    if keys[i + r] != key:
                        if (out := done()) is not None:
                            yield out
                        key, nodes_, sets_, have = keys[i + r], [], [], set()
                    s = h[at[r] : at[r + 1]]
                    # rows may share an id: only the one with the node's set counts
                    if node[i + r] not in have and _fingerprint(s) == node[i + r]:
                        have.add(node[i + r])
                        nodes_.append(node[i + r])
                        sets_.append(s.copy())
        if (out := done()) is not None:
            yield out

    linked = components(held(placed, True))
    if (blocks.agg(F.max("nb")).first()[0] or 0) > 2:
        linked = extended(linked, held(apart(placed.where("nb > 2"), "c", linked), False))
    ids = every.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    ids = ids.join(linked, "node", "left").select("node", "first", F.coalesce("component", "node").alias("c"))
    ids = persisted(ids.where("first is not null"), "nodes")
    least = ids.groupBy("c").agg(F.min("first").alias("component_id"))
    of = persisted(ids.join(least, "c").select("node", "component_id"), "components")
    return every.join(of, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id")
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


OP3_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
                      else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) end as sh
  from w
),
e as (select doc_id, len(sh) as n, unnest(sh) as h from s),
links as (
  select a.doc_id as x, b.doc_id as y
  from e a join e b on a.h = b.h and a.doc_id < b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
either as (select x, y from links union all select y, x from links),
reach as (select doc_id as node, doc_id as other from s union select r.node, b.y from reach r join either b on b.x = r.other)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, min(r.other) as component_id
from s join reach r on r.node = s.doc_id group by s.doc_id, s.sh
"""
