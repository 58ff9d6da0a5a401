"""Quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages (PASSAGE bytes each, the whole text). Each passage is encoded: counts of character
classes and of every ASCII sign, word lengths, word and line repetition go through a learned layer. Gated attention
(tanh times sigmoid) weighs the passages, and the weighted sum is scored by a logistic unit. Layer, gates and scorer
are learned together from document labels alone, by gradient descent in numpy on the driver.

Training takes a bounded sample of labelled rows: of the MAX_TRAIN labelled documents of smallest id hash those of at
most MAX_BAG passages, in that order, up to MAX_PASSAGES passages in all; the three are parameters. Every passage of a
sampled row is learned from. The sample's labels (MAX_TRAIN rows at most) are broadcast to find its documents. Of the
rows of a repeated id the one of smallest text hash is trained on, chosen in each partition first, so a frequent id
takes the room of one document and the order of rows doesn't matter. Scoring is one narrow pass over all passages of
all documents, whatever their length: no shuffle. A text is encoded SLICE bytes at a time, so beside the text itself
memory holds its passages' features, a third of a byte for each byte.

Null and empty texts are one empty passage and get a score too. Null ids and ids without label are never trained on,
nor are null ids held out;
null labels are ignored, and of repeated labels of an id the largest counts. Without any label, or with one class
only, every score is the share of label 1 (0.5 if none). Rows are scored one by one, repeated ones alike. Columns
besides doc_id and text are not read; keep() hands them on as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import bounded_batches
from .text import LONG, LOWER, chunks, digests, lean, prefix_sums, range_hash, utf8, words

PASSAGE = 512
MAX_TRAIN = 6000
LAST = (b"\xff" * 33,)  # after every text's hash
MAX_BAG = 1024
MAX_PASSAGES = 200_000
SLICE = 1 << 19
HIDDEN, GATE, EPOCHS, RATE, DECAY, BAGS = 24, 16, 40, 0.01, 1e-4, 256
THRESHOLD = 0.3

_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]


def _classes() -> np.ndarray:
    """256 x classes: upper, lower, digit, space, newline, other control, beyond ASCII, and each sign."""
    m = np.zeros((256, 7 + len(_SIGNS)), np.float32)
    m[65:91, 0] = m[97:123, 1] = m[48:58, 2] = m[[9, 32], 3] = m[[10, 13], 4] = 1
    m[[b for b in range(32) if b not in (9, 10, 13)] + [127], 5] = 1
    m[128:, 6] = 1
    for i, b in enumerate(_SIGNS):
        m[b, 7 + i] = 1
    return m


CLASSES = _classes()
N_FEATURES = CLASSES.shape[1] + 6


def _passages(x: np.ndarray, buf: np.ndarray, cuts: np.ndarray) -> None:
    """Fills the features that a passage has of itself; cuts are the offsets of the passages in buf."""
    n, c = len(cuts) - 1, CLASSES.shape[1]
    passage = np.repeat(np.arange(n), np.diff(cuts))
    hist = np.bincount(passage * 256 + buf, minlength=n * 256).reshape(n, 256)
    x[:, :c] = np.sqrt((hist @ CLASSES) / np.maximum(1, hist.sum(1))[:, None])
    low = LOWER[buf]
    starts, ends, p = words(low, cuts)
    if len(starts):
        h = range_hash(prefix_sums(low), starts, ends)
        long = np.flatnonzero(ends - starts > LONG)
        h[long] = digests(low, starts[long], ends[long])
        many = np.maximum(1, np.bincount(p, minlength=n))
        x[:, c] = np.bincount(p, ends - starts, n) / many / 10
        twice = np.zeros(len(h), bool)
        twice[1:] = (h[1:] == h[:-1]) & (p[1:] == p[:-1])
        x[:, c + 1] = np.bincount(p, twice, n) / many
        order = np.lexsort((h, p))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (p[order][1:] != p[order][:-1])
        x[:, c + 2] = np.bincount(p[order[fresh]], minlength=n) / many


def _line_hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the lines [a, b), in ascending order, some SLICE bytes of them at a time."""
    h = np.empty(len(a), np.uint64)
    long = b - a > LONG
    at = np.flatnonzero(long)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(a[at], a[at[lo]] + SLICE)))
        start = a[at[lo]]
        h[at[lo:hi]] = digests(LOWER[buf[start : b[at[hi - 1]]]], a[at[lo:hi]] - start, b[at[lo:hi]] - start)
        lo = hi
    short = np.flatnonzero(~long)
    i = 0
    while i < len(short):
        lo = a[short[i]]
        j = int(np.searchsorted(a[short], lo + SLICE))
        s = prefix_sums(LOWER[buf[lo : b[short[j - 1]]]])
        h[short[i:j]] = range_hash(s, a[short[i:j]] - lo, b[short[i:j]] - lo)
        i = j
    return h


def encode(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and the first passage of each text (one more at the end)."""
    size = np.diff(offsets)
    per = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    n, c = int(first[-1]), CLASSES.shape[1]
    x = np.zeros((n, N_FEATURES), np.float32)
    cuts = np.append(np.repeat(offsets[:-1], per) + PASSAGE * (np.arange(n) - np.repeat(first[:-1], per)), offsets[-1])
    step = SLICE // PASSAGE
    i = 0
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(cuts, cuts[i] + SLICE, "right")) - 1, i + 4 * step))
        _passages(x[i:j], buf[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i])
        i = j
    # lines that the text repeats
    line = np.ones(256, bool)
    line[10] = False
    a, b, r = words(buf, offsets, line)
    if len(a):
        h = _line_hashes(buf, a, b) ^ (r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        lo, hi = a[again], b[again]
        total = np.concatenate([[0], np.cumsum(hi - lo)])

        def before(t):  # bytes of repeated lines that lie before t
            k = np.searchsorted(lo, t)
            return total[k] - np.where(k > 0, np.maximum(0, (hi[np.maximum(k - 1, 0)] if len(hi) else 0) - t), 0)

        x[:, c + 3] = np.diff(before(cuts)) / np.maximum(1, np.diff(cuts))
        at = np.searchsorted(cuts, a, "right") - 1
        x[:, c + 4] = np.log1p(np.bincount(at, minlength=n)) / 4
    x[:, c + 5] = np.repeat(size == 0, per)
    return x, first


def _forward(m, x, first):
    h = np.tanh((x - m["mean"]) / m["std"] @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["w"]
    size = np.diff(first)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
    a = e / np.repeat(np.add.reduceat(e, first[:-1]), size)
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -40, 40)))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> dict:
    """The model learned from bags of passage features and their labels."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return {"constant": share}
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    m = {
        "W": rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE),
        "c": rng.normal(0, 0.2, HIDDEN), "d": np.array(np.log(share / (1 - share))),
    }
    learned = list(m)
    m |= {"mean": every.mean(0, dtype=np.float64), "std": every.std(0, dtype=np.float64) + 0.02}
    first, second, step = {k: np.zeros_like(m[k]) for k in learned}, {k: np.zeros_like(m[k]) for k in learned}, 0
    for epoch in range(EPOCHS):
        for x, at, y in _batches(bags, labels, rng.permutation(len(bags))):
            grad = gradient(m, x, at, y)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k in learned:
                q = grad[k] + DECAY * m[k]
                first[k] = 0.9 * first[k] + 0.1 * q
                second[k] = 0.999 * second[k] + 0.001 * q * q
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: np.asarray(v, np.float32) for k, v in m.items()}


def gradient(m: dict, x: np.ndarray, at: np.ndarray, labels: np.ndarray) -> dict:
    """Gradient of the mean cross entropy of some bags by each learned array."""
    h, t, s, a, z, p = _forward(m, x, at)
    size = np.diff(at)
    g = (p - labels) / len(labels)
    gz = np.repeat(g[:, None] * m["c"], size, axis=0)
    ga = (gz * h).sum(1)
    ge = a * (ga - np.repeat(np.add.reduceat(a * ga, at[:-1]), size))
    gt, gs = ge[:, None] * m["w"] * s * (1 - t * t), ge[:, None] * m["w"] * t * s * (1 - s)
    gh = (a[:, None] * gz + gt @ m["V"].T + gs @ m["U"].T) * (1 - h * h)
    xs = (x - m["mean"]) / m["std"]
    return {"W": xs.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "c": z.T @ g, "d": g.sum()}


def scores(m: dict, texts) -> np.ndarray:
    """Score of each text of an Arrow column."""
    buf, offsets = utf8(texts)
    out = np.zeros(len(offsets) - 1)
    if "constant" in m:
        out[:] = m["constant"]
        return out
    for i, j in chunks(offsets, SLICE):
        off = offsets[i : j + 1]
        x, first = encode(buf[off[0] : off[-1]], off - off[0])
        out[i:j] = _forward(m, x, first)[5]
    return out


def _batches(bags: list[np.ndarray], labels: np.ndarray, order: np.ndarray):
    """Passages, first passages and labels of BAGS documents at a time."""
    for lo in range(0, len(order), BAGS):
        some = order[lo : lo + BAGS]
        yield np.concatenate([bags[i] for i in some]), np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])]), labels[some]


def learn(
    docs: DataFrame, labels: DataFrame, held_out: int | None = 5, max_train: int = MAX_TRAIN, max_bag: int = MAX_BAG, max_passages: int = MAX_PASSAGES
) -> dict:
    """A model from docs(doc_id, text) and labels(doc_id, quality).

    With held_out = n, ids whose crc32 (as text) is divisible by n are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    if held_out:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % held_out != 0)
    some = rows.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches):
        held = {}  # of each id, the row of smallest key: as many as the sample has ids at most
        for batch in batches:
            best = {}
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                key = hashlib.sha256((text.as_py() or "").encode()).digest()
                if key < min(held.get(doc_id, LAST)[0], best.get(doc_id, LAST)[0]):
                    best[doc_id] = (key, k)
            if not best:
                continue
            batch = batch.take(pa.array([k for _, k in best.values()]))
            keys = [key for key, _ in best.values()]
            ids, grades = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            buf, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                off = offsets[i : j + 1]
                x, first = encode(buf[off[0] : off[-1]], off - off[0])
                for k in range(j - i):
                    held[ids[i + k]] = (keys[i + k], grades[i + k], x[first[k] : first[k + 1]].astype(np.float16).tobytes())
        rows = [(doc_id, *row) for doc_id, row in held.items()]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256]), kinds)], ["doc_id", "key", "quality", "bag"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = found.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bag * PASSAGE)
    found = found.join(F.broadcast(some), "doc_id").mapInArrow(lean(run), "doc_id long, key binary, quality int, bag binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("key", "quality", "bag")).alias("x")).select("doc_id", "x.quality", "x.bag")
    # a running sum over MAX_TRAIN rows at most
    upto = F.sum(F.octet_length("bag") / (2 * N_FEATURES)).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    found = found.withColumn("upto", upto).where(F.col("upto") <= max_passages)
    got = sorted((r.doc_id, r.quality, bytes(r.bag)) for r in found.collect())
    bags = [np.frombuffer(b, np.float16).astype(np.float32).reshape(-1, N_FEATURES) for _, _, b in got]
    return fit(bags, np.array([q for _, q, _ in got], np.float64))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted label of each row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            s = scores(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), "doc_id long, score double, predicted int"
    )


def keep(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(at)) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return score(docs, learn(docs, labels)).select("doc_id", held, "score", "predicted")
