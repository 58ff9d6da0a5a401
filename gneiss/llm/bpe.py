"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one engine per Spark partition.

A text is cut by the pre-tokenizer's pattern into words. The distinct words of a partition become token-position
rows (word, position, token, right neighbour). Each step of the recursive query finds every word's leftmost pair
of minimum rank (a pair's rank comes from a join with the merge table), contracts it, and looks up only the two
pairs that this changes; a word leaves the recursion when no pair of it can merge. Ordered aggregation over the rows
then gives a word's ids; joined with the vocabulary, ordered aggregation over ids gives its bytes, and over a
document's words the document's.

A word of LONG bytes and more is first cut into shorter ones. Overlapping pieces of it are encoded, and a place where
neighbouring pieces agree in a token is proposed as a cut. What lies between cuts is encoded as a word. A sequence of
tokens is the encoding of its bytes if and only if each two neighbours are the encoding of theirs, so every cut is
verified by encoding the two tokens beside it together; a cut that fails is taken back. What can't be cut (a run of one
letter whose tokens shift) is contracted whole, all pairs of its minimum rank in a step.

Words go to the engine in blocks of bounded size, texts in slices, and digests are updated slice by slice. Words met
before in the same worker come from a bounded cache. Beside the text itself memory holds one slice.

Null and empty texts have no ids and decode to no bytes. Rows are encoded one by one, repeated ones too. An empty
table gives an empty table; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .store import bounded_batches

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
STEPS = 48  # recursion steps of one query
ROWS = 4_000_000  # rows that all steps of one query may leave
LONG = 256  # bytes from which a word is cut
STRIDES = (48, 384)  # half of the pieces' sizes, smaller ones first
SEGMENT = 1 << 15  # bytes of a long word that are cut at a time
BLOCK_BYTES = 500_000  # bytes of distinct words in one query
CHUNK_CHARS = 2_000_000  # text handled at a time
CACHE_WORDS = 800_000

ENCODE = """
with recursive s(it, w, p, q, l, r, k) as (
  select 0, seed.w, seed.p, seed.q, seed.l, seed.r, m.t::bigint << 32 | seed.p
  from seed left join merges m on m.ab = (seed.l::bigint << 32 | seed.r)
 union all
  select x.it, x.w, x.p, x.q, x.l, x.r,
         case when x.changed then m.t::bigint << 32 | x.p else x.k end
  from (
    select s.it + 1 as it, s.w, s.q, s.k,
           case when s.p = b.q then b.p else s.p end as p,
           case when s.p = b.q then b.t else s.l end as l,
           case when s.q = b.p then b.t else s.r end as r,
           s.p = b.q or s.q = b.p as changed
    from s
    join (select w, (min(k) & 4294967295)::int as p, arg_min(q, k) as q, (min(k) >> 32)::int as t, min(k) as k
          from s group by w having min(k) is not null) b on s.w = b.w
    where s.it < {steps} and s.k is distinct from b.k
  ) x
  left join merges m on x.changed and m.ab = (x.l::bigint << 32 | x.r)
)
select w, p, q, l, r, k from s join (select w, max(it) as it from s group by w) using (w, it)
"""

# The same for words that stay long: a step contracts every pair of the word's minimum rank, in runs every other one from the left.
# Leftmost-first contraction does just these one after the other: a pair that holds the new token ranks behind it, since
# one that ranked before it would have been contracted in an earlier step.
ENCODE_LONG = """
with recursive s(it, w, p, q, l, r, k) as (
  select 0, seed.w, seed.p, seed.q, seed.l, seed.r, m.t::bigint << 32 | seed.p
  from seed left join merges m on m.ab = (seed.l::bigint << 32 | seed.r)
 union all
  select x.it, x.w, x.p, x.q, x.l, x.r, m.t::bigint << 32 | x.p
  from (
    select it + 1 as it, w, q, now,
           case when lag(now) over o then lag(p) over o else p end as p,
           case when lag(now) over o then lag(t) over o else l end as l,
           case when lead(now) over o then lead(t) over o else r end as r
    from (
      select *, coalesce(t = low and (row_number() over (partition by w, t = low, island order by p)) % 2 = 1, false) as now
      from (
        select *, place - row_number() over (partition by w, t = low order by p) as island
        from (select s.*, (k >> 32)::int as t, (min(k) over (partition by w) >> 32)::int as low, row_number() over (partition by w order by p) as place
              from s where it < {steps})
      )
      where low is not null
    )
    window o as (partition by w order by p)
  ) x
  left join merges m on m.ab = (x.l::bigint << 32 | x.r)
  where not x.now
)
select w, p, q, l, r, k from s join (select w, max(it) as it from s group by w) using (w, it)
"""


class Engine:
    def __init__(self, path: str):
        import duckdb
        import regex

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(rank)
        self.words, self.cache = regex.compile(public_tokenizers.PATTERN), {}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole, self.whole_of = ranks, {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        spill = os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")  # made only if a query outgrows its memory
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": spill})
        self._register("m", ab=np.array(left, np.int64) << 32 | np.array(right, np.int64), t=np.array(to, np.int32))
        self.db.execute("create table merges as select ab, t from m order by ab")
        named = {r: t.hex() for t, r in ranks.items()}
        self.db.register("v", pa.table({"t": pa.array(range(max(named) + 1), pa.int32()), "b": pa.array([named.get(i) for i in range(max(named) + 1)])}))
        self.db.execute("create table vocabulary as select list(b order by t) as b from v")

    def _register(self, name: str, **columns):
        self.db.register(name, pa.table({k: pa.array(v) for k, v in columns.items()}))

    def _rows(self, query: str) -> pa.Table:
        return self.db.sql(query).to_arrow_table()

    def encode(self, blobs: list[bytes]) -> pa.Table:
        """Per word, in order of w: its ids, comma-joined, their number, and the decoded bytes in hex."""
        lengths = np.array([len(b) for b in blobs], np.int64)
        ends = np.cumsum(lengths)
        buf = np.frombuffer(b"".join(blobs), np.uint8)
        left = self.byte[buf]
        right = np.full(len(buf), -1, np.int32)
        right[:-1] = left[1:]
        right[ends - 1] = -1
        p = (np.arange(len(buf)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        w = np.repeat(np.arange(len(blobs), dtype=np.int32), lengths)
        every, done = pa.table({"w": w, "p": p, "q": p + np.int32(1), "l": left, "r": right}), []
        long = np.repeat(lengths >= LONG, lengths)
        for query, state in ((ENCODE, every.filter(pa.array(~long))), (ENCODE_LONG, every.filter(pa.array(long)))):
            while state.num_rows:
                self.db.register("seed", state)
                got = self._rows(query.format(steps=max(1, min(STEPS, ROWS // state.num_rows))))
                w, k = got["w"].to_numpy(), got["k"].to_numpy(zero_copy_only=False)
                pending = np.unique(w[~np.isnan(k.astype(float))])
                more = np.isin(w, pending)
                done.append(got.filter(pa.array(~more)).select(["w", "p", "l"]))
                state = got.filter(pa.array(more)).select(["w", "p", "q", "l", "r"])
        self.db.register("tokens", pa.concat_tables(done))
        return self._rows(
            "select w, len(ids) as n, array_to_string(ids, ',') as ids, array_to_string(list_select(b, list_transform(ids, lambda x: x + 1)), '') as hex"
            " from (select w, list(l order by p) as ids from tokens group by w), vocabulary order by w"
        )

    def lookup(self, words: set) -> dict:
        """(number of ids, ids, decoded hex) of each word, a string or bytes."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        found = {x: y for x in words if (y := cache.get(x)) is not None}
        todo = [x for x in words if x not in found]
        blobs = [x if isinstance(x, bytes) else x.encode("utf-8") for x in todo]
        # a word's steps grow with its length, and each leaves rows
        ends = np.cumsum([len(b) * max(1, len(b) // 16) for b in blobs])
        i = 0
        while i < len(todo):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_BYTES, "right")))
            got = self.encode(blobs[i:j])
            codes = zip(got["n"].to_pylist(), got["ids"].to_pylist(), got["hex"].to_pylist())
            found.update(zip(todo[i:j], codes))
            i = j
        cache.update((x, found[x]) for x in todo if len(x) < 64)
        return found

    def _proposed(self, raw: bytes, stride: int) -> list[int]:
        """Places of raw where overlapping pieces of two strides agree in a token."""
        starts = range(0, max(1, len(raw) - stride), stride)
        pieces = [raw[a : a + 2 * stride] for a in starts]
        codes, tokens = self.lookup(set(pieces)), {}
        for piece, (_, ids, _) in codes.items():
            ids = [int(t) for t in ids.split(",")]
            ends = np.cumsum([self.size[t] for t in ids]).tolist()
            tokens[piece] = list(zip([0, *ends], ids))
        out = []
        for a, one, two in zip(starts[1:], pieces, pieces[1:]):
            both = {(p - stride, t) for p, t in tokens[one] if p >= stride}.intersection(tokens[two])
            out += [a + min(both)[0]] if both else []
        return [x for x in out if x]

    def parts(self, raw: bytes):
        """raw cut into words whose encodings, one after the other, are raw's."""
        at, size, last = 0, SEGMENT, None
        while at < len(raw):
            end = min(len(raw), at + size)
            cuts: list[int] = []
            for stride in STRIDES:
                cuts = cuts or self._proposed(raw[at:end], stride)
            if not cuts and end < len(raw):
                size *= 2
                continue
            stop = len(raw) if end == len(raw) else at + cuts[-1]
            words = [raw[at + a : at + b] for a, b in zip([0, *cuts], [*cuts, end - at]) if at + a < stop]
            words = [last, *words] if last else words
            while True:
                codes = self.lookup(set(words))
                edge = [tuple(self.whole_of[int(t)] for t in (codes[w][1].split(",", 1)[0], codes[w][1].rsplit(",", 1)[-1])) for w in words]
                pairs = [(x[1], y[0]) for x, y in zip(edge, edge[1:])]
                met = self.lookup({x + y for x, y in pairs})
                good = [met[x + y][1] == f"{self.whole[x]},{self.whole[y]}" for x, y in pairs]
                if all(good):
                    break
                joined = [words[0]]
                for word, ok in zip(words[1:], good):
                    joined += [word] if ok else []
                    if not ok:
                        joined[-1] += word
                words = joined
            at, size = stop, SEGMENT
            last = words.pop()  # the next segment's first cut is verified against it
            yield from words
        if last:
            yield last

    def slices(self, texts: list[str]):
        """Lists of (text's number, words), CHUNK_CHARS of text at a time."""
        held, size = [], 0
        for d, text in enumerate(texts):
            words: list = []
            if len(text) < CHUNK_CHARS:
                matches = self.words.findall(text)
                if 4 * max(map(len, matches), default=0) < LONG:  # no character takes more than four bytes
                    words, matches = matches, ()
                    size += len(text)
            else:
                matches = (m.group() for m in self.words.finditer(text))
            for word in matches:
                long = len(word) >= LONG or 4 * len(word) >= LONG and len(word.encode("utf-8")) >= LONG
                for x in self.parts(word.encode("utf-8")) if long else (word,):
                    words.append(x)
                    size += len(x)
                    if size >= CHUNK_CHARS:
                        yield [*held, (d, words)]
                        held, words, size = [], [], 0
            if words:
                held.append((d, words))
            if size >= CHUNK_CHARS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def documents(self, texts: list[str], full: bool = False) -> list[tuple]:
        """(number of ids, digests of ids and of decoded bytes, and, if full, both themselves) of each text."""
        state = [[0, hashlib.sha256(), hashlib.sha256(), [], []] for _ in texts]
        for part in self.slices(texts):
            for d, n, ids, raw in self._joined(part):
                s = state[d]
                s[1].update(("," if s[0] else "").encode() + ids.encode())
                s[2].update(raw)
                s[0] += n
                if full:
                    s[3].append(ids)
                    s[4].append(raw)
        return [(n, a.hexdigest(), b.hexdigest(), ",".join(ids), b"".join(raw)) for n, a, b, ids, raw in state]

    def _joined(self, part: list[tuple[int, list]]) -> list[tuple[int, int, str, bytes]]:
        """(text, number of ids, ids, decoded bytes) of each text's words, by ordered aggregation over them."""
        codes = self.lookup(set().union(*(words for _, words in part)))
        number = dict(zip(codes, range(len(codes))))
        word_of = np.array([i for _, ws in part for i in map(number.__getitem__, ws)], np.int32)
        n, ids, hexes = zip(*codes.values())
        self.db.register("words", pa.table({"w": np.arange(len(n), dtype=np.int32), "ids": pa.array(ids, pa.large_string()), "hex": pa.array(hexes, pa.large_string())}))
        doc = np.repeat(np.arange(len(part), dtype=np.int32), [len(ws) for _, ws in part])
        self.db.register("places", pa.table({"d": doc, "i": np.arange(len(doc), dtype=np.int32), "w": word_of}))
        got = self._rows(
            "with all_words as (select list(ids order by w) as ids, list(hex order by w) as hex from words),"
            " texts as (select d, list(w + 1 order by i) as ws from places group by d)"
            " select d, array_to_string(list_select(ids, ws), ',') as ids, array_to_string(list_select(hex, ws), '') as hex from texts, all_words order by d"
        )
        total = np.bincount(doc, np.array(n)[word_of], len(part)).astype(np.int64).tolist()
        return [(part[d][0], total[d], a, bytes.fromhex(b)) for d, a, b in zip(*(got[x].to_pylist() for x in ("d", "ids", "hex")))]


@lru_cache(maxsize=2)
def engine(path: str) -> Engine:
    return Engine(path)


def encode_decode(docs: DataFrame, ranks: str | None = None, full: bool = False) -> DataFrame:
    """Ids of each text of docs(doc_id, text) and their decoding, as digests; with full, also ids and decoded text."""
    bounded_batches(docs.sparkSession)
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        eng = engine(path)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            i = 0
            while i < len(texts):
                chunk, size, j = [], 0, i
                while j < len(texts) and (not chunk or size < CHUNK_CHARS):
                    chunk.append(texts[j].as_py() or "")
                    size += len(chunk[-1])
                    j += 1
                rows = eng.documents(chunk, full)
                arrays = [docs.slice(i, j - i), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    arrays += [pa.array([[int(t) for t in r[3].split(",") if t] for r in rows], pa.list_(pa.int32())), pa.array([r[4].decode("utf-8") for r in rows])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)
                i = j

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        run, SCHEMA + (", ids array<int>, decoded string" if full else "")
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
