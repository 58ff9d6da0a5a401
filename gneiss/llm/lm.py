"""Language-model scoring over a sharded Elias-Fano trie of word n-grams, up to trigrams.

P3(w | u v) = (c(u v w) + MU * P2(w | v)) / (c(u v) + MU), P2(w | v) = (c(v w) + MU * P1(w)) / (c(v) + MU) and
P1(w) = (c(w) + 1) / (N + V + 1): Dirichlet smoothing towards the shorter context. Each sums to one over the V known
tokens and one unknown. A text's first token has the begin as its only context. Counts are over all training texts. The
trie's probabilities are quantised to eight bits in steps of a twelfth, as is the weight MU / (c(u v) + MU).

1. Texts become blocks of about BLOCK_BYTES: the block's distinct tokens (64-bit hashes), their training counts, and
   the tokens as indices into these. Blocks are written to the shared folder; nothing later reads the texts.
2. Distinct tokens are dealt by hash slice; each slice sums counts over blocks, ranks its tokens by count, and answers
   every block with the totals and ranks of its tokens. (rank, slice) is a token's number from here on: small for
   frequent tokens, and exact up to the 64-bit hash. A frequent word costs one entry for each block.
3. A block's distinct n-grams go to shards as a small trie: contexts, their successors, and these ones' successors, with
   training counts. A context that holds more than a shard's part of all tokens is split by successor; so is a bigram
   that holds so much as a context of trigrams, whose own count then goes to each of its shards. A shard builds the trie
   of all training n-grams and answers every block's n-grams from it.
4. Each block meets its answers and scores its texts.

Nulls and empty texts are one end token. A null id counts as trained on. Rows are scored one by one, repeated ones
too. An empty table gives an empty table; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches, persisted
from .text import chunks, mix, utf8, word_hashes
from .trie import VALUES, Trie

MU = 20.0
ORDER = 3
BLOCK_BYTES = 4 << 20
SHARD_TOKENS = 1_500_000
LEAST_SHARDS = 12
END = np.uint64(0xE11D0F7E47000001)  # no word hashes: see _tokens
BEGIN = np.uint64(1 << 63)  # no token's number
FIND = 1 << 18  # n-grams that are looked up at a time

_small = zstandard.ZstdCompressor(level=1)


def _pack(a: np.ndarray) -> bytes:
    return _small.compress(np.ascontiguousarray(a).tobytes())


def _unpack(b, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_planes(a: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers, byte by byte: bytes that are alike lie together, and unused ones take no room."""
    return _pack(np.ascontiguousarray(a, kind).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros(0, np.uint8))


def _unpack_planes(b, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _tokens(buf, offsets):
    """Hashes of all texts' tokens, each text's end included, and the number of tokens of each text."""
    h, rows = word_hashes(buf, offsets)
    h[h == END] += np.uint64(1)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    out = np.full(len(h) + len(n), END, np.uint64)
    out[np.arange(len(h)) + rows] = h
    return out, n + 1


def blocks_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        number, part = 0, TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                off = offsets[i : j + 1]
                parts.append((ids[i:j], held[i:j], *_tokens(buf[off[0] : off[-1]], off - off[0])))
                size += int(off[-1] - off[0])
                if size >= BLOCK_BYTES:
                    yield block(part + number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield block(part + number, parts)

    def block(number, parts):
        ids, held, h, n = zip(*parts)
        held, h, n = np.concatenate(held), np.concatenate(h), np.concatenate(n)
        known, index, times = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent tokens get small indices
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        known, index = known[order], place[index]
        count = np.bincount(index[np.repeat(~held, n)], minlength=len(known))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]), pa.array([[i for x in ids for i in x]], pa.list_(pa.int64())), pa.array([_pack(held)]), pa.array([_pack_planes(n)]),
                pa.array([_pack(known)]), pa.array([_pack_planes(count)]), pa.array([_pack_planes(index)]), pa.array([len(h)]), pa.array([int((~held).sum())]),
            ],
            ["block", "ids", "held", "n", "known", "train", "stream", "tokens", "trained"],
        )

    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held"),
    )
    return text.mapInArrow(run, "block long, ids array<long>, held binary, n binary, known binary, train binary, stream binary, tokens long, trained long")


class Grams:
    """A block's distinct n-grams, laid out by shard. Made twice from the same arrays, to ask and to read the answers."""

    def __init__(self, stream, n, held, number, c, begins: int, shards: int, total: int, order: int):
        first = np.cumsum(n) - n
        trained = np.repeat(~held, n)
        stream = stream.astype(np.uint64)
        context = np.empty(len(stream), np.uint64)
        context[1:] = stream[:-1] + np.uint64(1)
        context[first] = 0
        pair, self.pair_of = np.unique(context << np.uint64(32) | stream, return_inverse=True)
        self.count = np.bincount(self.pair_of[trained], minlength=len(pair))
        u, v = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        u_id, v_id = np.where(u > 0, number[u - 1], BEGIN), number[v]
        c_u, c_v = np.where(u > 0, c[u - 1], begins), c[v]
        share = lambda held_: np.maximum(1, -(-held_ * shards // max(1, total)))
        parts_u = share(c_u)
        key = u_id * np.uint64(0x9E3779B97F4A7C15) + v_id % parts_u.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        shard = (mix(key + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
        parts = np.minimum(shards, share(np.minimum(c_u, c_v))) if order > 2 else np.ones(len(pair), np.int64)
        start = np.cumsum(parts) - parts
        entry = np.repeat(np.arange(len(pair)), parts)  # a pair has an entry in each shard that holds some of its successors
        part = np.arange(len(entry)) - start[entry]
        where = (shard[entry] + part) % shards
        by = np.argsort(where, kind="stable")
        self.pair, self.shard, self.main = entry[by], where[by], part[by] == 0
        self.u, self.v = u_id[self.pair], v_id[self.pair]
        self.c_u, self.hot = c_u, np.where(parts_u > 1, c_u, 0)[self.pair]
        self.inner = np.ones(len(stream), bool)  # tokens that end a trigram
        self.inner[first] = False
        if order < 3:
            self.inner[:] = False
        i = np.flatnonzero(self.inner)
        triple, self.triple_of = np.unique(self.pair_of[i - 1].astype(np.uint64) << np.uint64(32) | stream[i], return_inverse=True)
        count = np.bincount(self.triple_of[trained[i]], minlength=len(triple))
        p, w = (triple >> np.uint64(32)).astype(np.int64), number[(triple & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        at = place[start[p] + (w % parts[p].astype(np.uint64)).astype(np.int64)] if len(p) else p
        self.order = np.argsort(at, kind="stable")
        self.parent, self.w, self.count3 = at[self.order], w[self.order], count[self.order]

    def rows(self, block: int):
        """One row for each shard: contexts, how many successors each has, these, their counts, and the same below them."""
        begin = np.flatnonzero(np.diff(self.shard, prepend=-1))
        children = np.bincount(self.parent, minlength=len(self.pair))
        below = np.searchsorted(self.parent, [*begin, len(self.pair)])
        for k, (a, b) in enumerate(zip(begin, [*begin[1:], len(self.pair)])):
            head = np.flatnonzero(np.concatenate([[True], self.u[a + 1 : b] != self.u[a : b - 1]]))
            x, y = below[k], below[k + 1]
            cells = [
                _pack_planes(self.u[a:b][head], "<u8"), _pack_planes(np.diff(np.append(head, b - a))), _pack_planes(self.hot[a:b][head], "<u8"),
                _pack_planes(self.v[a:b], "<u8"), _pack_planes(self.count[self.pair[a:b]]), _pack_planes(children[a:b]),
                _pack_planes(self.w[x:y], "<u8"), _pack_planes(self.count3[x:y]),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(self.shard[a])], pa.int32()), pa.array([block]), *[pa.array([c], pa.binary()) for c in cells]],
                ["shard", "block", "u", "nu", "cu", "v", "cv", "nv", "w", "cw"],
            )


def _groups(batches, key: int):
    """Rows of sorted batches, gathered by a key column."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[key] != now and held:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def score(docs: DataFrame, mu: float = MU, order: int = ORDER) -> DataFrame:
    """Base and model scores of each row of docs(doc_id, text); order is 2 for bigrams, 3 for trigrams."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = persisted(blocks_of(docs), "blocks")
    total, trained = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum("trained")).first())
    shards = max(LEAST_SHARDS, -(-total // SHARD_TOKENS))

    def slice_of(known):
        return ((known >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)

    def slices(batches):
        for batch in batches:
            for block, known, train in zip(*(batch.column(c).to_pylist() for c in range(3))):
                known, train = _unpack(known, np.uint64), _unpack_planes(train)
                which = slice_of(known)
                by = np.argsort(which, kind="stable")
                known, train, which = known[by], train[by], which[by]
                at = np.flatnonzero(np.diff(which, prepend=-1))
                for a, b in zip(at, [*at[1:], len(known)]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(which[a])], pa.int32()), pa.array([block]), pa.array([_pack(known[a:b])]), pa.array([_pack_planes(train[a:b])])],
                        ["slice", "block", "known", "train"],
                    )

    def sums(batches):
        def row(block, which, counts, ranks, n, v):
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, which, counts, ranks, n, v), kinds)], ["block", "slice", "counts", "ranks", "n", "v"])

        for which, rows in _groups(batches, 0):
            known = [_unpack(r[2], np.uint64) for r in rows]
            every, inverse = np.unique(np.concatenate(known), return_inverse=True)
            count = np.zeros(len(every), np.int64)
            np.add.at(count, inverse, np.concatenate([_unpack_planes(r[3]) for r in rows]).astype(np.int64))
            rank = np.empty(len(every), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(every))
            at = 0
            for r, k in zip(rows, known):
                mine = inverse[at : at + len(k)]
                yield row(r[1], which, _pack_planes(count[mine], "<u8"), _pack_planes(rank[mine], "<u8"), 0, 0)
                at += len(k)
            yield row(-1, which, b"", b"", int(count.sum()), int((count > 0).sum()))

    counts = persisted(
        blocks.select("block", "known", "train")
        .mapInArrow(slices, "slice int, block long, known binary, train binary")
        .repartitionById(shards, "slice")
        .sortWithinPartitions("slice", "block")
        .mapInArrow(sums, "block long, slice int, counts binary, ranks binary, n long, v long"),
        "counts",
    )
    sizes = counts.where("block = -1").agg(F.sum("n"), F.sum("v")).first()
    n_train, n_known = int(sizes[0] or 0), int(sizes[1] or 0)

    def light(batches):
        """Blocks without hashes: which slice each token went to says where its answers are."""
        for batch in batches:
            which = [_pack_planes(slice_of(_unpack(x.as_py(), np.uint64))) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(which, pa.binary()), batch.column(5)], ["block", "ids", "held", "n", "which", "stream"])

    meta = ["ids", "held", "n", "which", "stream"]
    bare = blocks.select("block", "ids", "held", "n", "known", "stream").mapInArrow(light, "block long, ids array<long>, held binary, n binary, which binary, stream binary")
    none = [F.lit(None).cast("array<long>"), *[F.lit(None).cast("binary")] * 4]
    with_counts = bare.select("block", F.lit(0).alias("kind"), F.lit(0).alias("part"), *[F.lit(None).cast("binary").alias(x) for x in ("one", "two", "three")], *meta).unionAll(
        counts.where("block >= 0").select("block", F.lit(1), "slice", "counts", "ranks", F.lit(None).cast("binary"), *none)
    )

    def met(rows):
        """A block's texts' ids, its arrays, and its n-grams, from its own row and its answers from the slices."""
        ids, held, n, which, stream = rows[0][6:]
        held, n, which, stream = _unpack(held, bool), _unpack_planes(n).astype(np.int64), _unpack_planes(which).astype(np.int64), _unpack_planes(stream)
        by = np.argsort(which, kind="stable")
        c, number = np.empty(len(which), np.int64), np.empty(len(which), np.uint64)
        answers = [r for r in rows if r[1] == 1]
        c[by] = np.concatenate([_unpack_planes(r[3], "<u8") for r in answers]).astype(np.int64)
        number[by] = np.concatenate([_unpack_planes(r[4], "<u8") for r in answers]) * np.uint64(shards) + which[by].astype(np.uint64)
        return ids, held, n, stream, c, Grams(stream, n, held, number, c, trained, shards, n_train, order)

    def deal(batches):
        for block, rows in _groups(batches, 0):
            yield from met(rows)[-1].rows(block)

    def answer(batches):
        for which, rows in _groups(batches, 0):
            u, nu, hot = ([_unpack_planes(r[i], k) for r in rows] for i, k in ((2, "<u8"), (3, "<u4"), (4, "<u8")))
            v, cv, nv = ([_unpack_planes(r[i], k) for r in rows] for i, k in ((5, "<u8"), (6, "<u4"), (7, "<u4")))
            w, cw = ([_unpack_planes(r[i], k) for r in rows] for i, k in ((8, "<u8"), (9, "<u4")))
            sizes2, sizes3 = [len(x) for x in v], [len(x) for x in w]
            heads = np.concatenate(nu)
            context, hot = np.repeat(np.concatenate(u), heads), np.repeat(np.concatenate(hot).astype(np.int64), heads)
            v, cv, w, cw = (np.concatenate(x) for x in (v, cv, w, cw))
            parent = np.repeat(np.arange(len(v)), np.concatenate(nv))
            trie = Trie(context, v, cv, hot, parent, w, cw, mu)
            at2 = at3 = 0
            for r, n2, n3 in zip(rows, sizes2, sizes3):
                found = np.concatenate([trie.bigrams(context[x : min(x + FIND, at2 + n2)], v[x : min(x + FIND, at2 + n2)]) for x in range(at2, at2 + n2, FIND)])
                below = found[parent[at3 : at3 + n3] - at2]
                codes = [trie.trigrams(below[x : x + FIND], w[at3 + x : at3 + min(x + FIND, n3)]) for x in range(0, n3, FIND)]
                cells = [_pack(trie.codes_of(found)), _pack(trie.weights_of(found)), _pack(np.concatenate([np.zeros(0, np.uint8), *codes]))]
                at2, at3 = at2 + n2, at3 + n3
                yield pa.RecordBatch.from_arrays([pa.array([r[1]]), pa.array([which], pa.int32()), *[pa.array([c]) for c in cells]], ["block", "part", "one", "two", "three"])

    replies = persisted(
        with_counts.repartition("block")
        .sortWithinPartitions("block", "kind", "part")
        .mapInArrow(deal, "shard int, block long, u binary, nu binary, cu binary, v binary, cv binary, nv binary, w binary, cw binary")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "block")
        .mapInArrow(answer, "block long, part int, one binary, two binary, three binary"),
        "replies",
    )
    gathered = (
        with_counts.unionAll(replies.select("block", F.lit(2), "part", "one", "two", "three", *none)).repartition("block").sortWithinPartitions("block", "kind", "part")
    )

    def finish(batches):
        log_all = np.log10(float(n_train + n_known + 1))
        for _, rows in _groups(batches, 0):
            ids, held, n, stream, c, grams = met(rows)
            code, weight = np.zeros(len(grams.c_u), np.uint8), np.zeros(len(grams.c_u), np.uint8)
            one, two, three = (np.concatenate([_unpack(r[i], np.uint8) for r in rows if r[1] == 2]) for i in (3, 4, 5))
            code[grams.pair[grams.main]], weight[grams.pair[grams.main]] = one[grams.main], two[grams.main]
            code3 = np.empty(len(grams.order), np.uint8)
            code3[grams.order] = three
            p1 = (c[stream] + 1.0) / (n_train + n_known + 1)
            p = VALUES[code][grams.pair_of] + (mu / (grams.c_u + mu))[grams.pair_of] * p1
            i = np.flatnonzero(grams.inner)
            p[i] = VALUES[code3][grams.triple_of] + VALUES[weight][grams.pair_of[i - 1]] * p[i]
            log_p = np.log10(p)
            at = np.cumsum(n) - n
            base = np.add.reduceat(np.log10(c + 1.0)[stream] - log_all, at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(held), pa.array(n), pa.array(np.add.reduceat((c > 0)[stream].astype(np.int64), at)),
                    pa.array(np.full(len(n), n_train)), pa.array(base), pa.array(np.add.reduceat(log_p, at)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return gathered.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
