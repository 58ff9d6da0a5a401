"""A three-level n-gram trie in Elias-Fano form, built and queried with numpy.

All levels are monotone sequences. Level one holds the contexts' numbers. Level two holds each context's successors, made
monotone by the context's index above them, so a successor is searched relative to its context; level three holds each
bigram's successors in the same way. A successor is its rank among all successors of the shard, a monotone sequence of
its own, so equal ranks are equal tokens. Pointers from contexts to their successors, and from bigrams to theirs, are two
more. Smoothed probabilities, and the weights that a bigram leaves to shorter contexts, are quantised to eight bits. The
levels lie one after the other in one memory map.
"""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64


class Levels:
    """Arrays in one anonymous memory map: pages are taken as they are written and go back when the map goes."""

    def __init__(self, size: int):
        self.map, self.at = mmap.mmap(-1, max(1, size)), 0

    def put(self, a: np.ndarray) -> np.ndarray:
        out = np.frombuffer(self.map, a.dtype, len(a), self.at)
        out[:] = a
        self.at += -(-a.nbytes // 8) * 8
        return out


_L1, _H1 = U(0x0101010101010101), U(0x8080808080808080)
_IN_BYTE = np.zeros((256, 8), np.int64)  # where a byte's k-th set bit is
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_at)] = _at


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word: bytes' prefix counts in one multiplication, then a table."""
    x = word - (word >> U(1) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + (x >> U(2) & U(0x3333333333333333))
    upto = (x + (x >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * _L1
    k = k.astype(U)
    shift = np.bitwise_count((k * _L1 | _H1) - upto & _H1).astype(U) << U(3)
    before = (upto << U(8)) >> shift & U(255)
    return shift.astype(np.int64) + _IN_BYTE[word >> shift & U(255), k - before]


class EliasFano:
    """A sorted sequence of integers below `universe`, about 2 + log2(universe / n) bits each."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = n = len(values)
        self.low = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        high = (values >> U(self.low)).astype(np.int64)
        self.buckets = (universe >> self.low) + 1
        size = -(-(n + self.buckets + 1) // 64)
        bits = np.zeros(size * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.upper = np.packbits(bits, bitorder="little").view(U)
        ones = np.bitwise_count(self.upper).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(ones)])
        words = np.zeros(-(-n * self.low // 64) + 2, U)
        if self.low:
            at = np.arange(n) * self.low
            low = values & U((1 << self.low) - 1)
            np.bitwise_or.at(words, at >> 6, low << (at & 63).astype(U))
            over = (at & 63) + self.low > 64
            np.bitwise_or.at(words, (at[over] >> 6) + 1, low[over] >> (64 - (at[over] & 63)).astype(U))
        self.lower = words

    def move(self, levels: Levels) -> "EliasFano":
        self.upper, self.rank, self.lower = (levels.put(x) for x in (self.upper, self.rank, self.lower))
        return self

    def nbytes(self) -> int:
        return self.upper.nbytes + self.rank.nbytes + self.lower.nbytes + 64

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U)
        at = i * self.low
        w, s = at >> 6, (at & 63).astype(U)
        x = self.lower[w] >> s
        y = np.where(s > 0, self.lower[w + 1] << ((U(64) - s) & U(63)), U(0))
        return (x | y) & U((1 << self.low) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the upper bits; the k-th zero ends bucket k."""
        zeros = np.arange(len(self.rank)) * 64 - self.rank  # before each word
        word = np.minimum(np.searchsorted(zeros, k, "right") - 1, len(self.upper) - 1)
        return word * 64 + _select(~self.upper[word], k - zeros[word])

    def _bucket(self, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values lie in buckets below, and how many there are with those in the bucket."""
        at = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) + 1, 0)  # the bucket's first bit
        first = at - bucket
        last = len(self.upper) - 1
        word, s = at >> 6, (at & 63).astype(U)
        rest = np.where(word < last, self.upper[np.minimum(word + 1, last)], U(0))
        bits = np.where(word <= last, self.upper[np.minimum(word, last)] >> s | np.where(s > 0, rest << (U(64) - s & U(63)), U(0)), U(0))
        run = np.bitwise_count(bits ^ (bits + U(1))).astype(np.int64) - 1  # ones from there on
        long = np.flatnonzero(bits == U(0xFFFFFFFFFFFFFFFF))
        run[long] = self._zero(bucket[long]) - at[long]
        return first, first + run

    def next_geq(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= q (n if none) and whether it equals q."""
        bucket = np.minimum((q >> U(self.low)).astype(np.int64), self.buckets - 1)
        lo, end = self._bucket(bucket)
        want = q & U((1 << self.low) - 1)
        open_ = np.flatnonzero(lo < end)
        a, b, w = lo[open_], end[open_], want[open_]
        while len(open_):
            mid = (a + b) >> 1
            less = self._low(mid) < w
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            done = a >= b
            lo[open_[done]] = a[done]
            left = ~done
            open_, a, b, w = open_[left], a[left], b[left], w[left]
        same = lo < end
        same[same] = self._low(lo[same]) == want[same]
        return lo, same

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at some indices."""
        word = np.searchsorted(self.rank, i, "right") - 1
        place = _select(self.upper[word], i - self.rank[word])
        return ((word * 64 + place - i).astype(U) << U(self.low)) | self._low(i)


FLOOR = -9.0  # log10 of the smallest probability that has a code of its own
STEP = -FLOOR / 254


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1..255 of probabilities; 0 stands for none."""
    return (1 + np.clip(np.rint((np.log10(p) - FLOOR) / STEP), 0, 254)).astype(np.uint8)


VALUES = np.concatenate([[0.0], 10 ** (FLOOR + STEP * np.arange(255))])


def _summed(parent: np.ndarray, rank: np.ndarray, count: np.ndarray):
    """Distinct (parent, rank) in order, their summed counts, and which of them each row is."""
    order = np.lexsort((rank, parent))
    p, r = parent[order], rank[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    of = np.empty(len(p), np.int64)
    of[order] = np.cumsum(new) - 1
    return p[at], r[at], np.add.reduceat(count[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64), of


class Trie:
    """Contexts, successors, and successors of these, with smoothed relative frequencies."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, count: np.ndarray, whole: np.ndarray, parent: np.ndarray, last: np.ndarray, count3: np.ndarray, mu: float):
        """Bigram rows (context, successor, count) and trigram rows (bigram row, last token, count) may repeat: counts add
        up; rows without a count are left out. whole is a context's count where the shard has a part of it, else 0."""
        seen, seen3 = count > 0, count3 > 0
        vocabulary = np.unique(np.concatenate([successor[seen], last[seen3]]).astype(U))
        rank = lambda x: np.searchsorted(vocabulary, x.astype(U))
        c, s, n, of = _summed(context[seen], rank(successor[seen]), count[seen])
        head = np.ones(len(c), bool)
        head[1:] = c[1:] != c[:-1]
        first = np.flatnonzero(head)
        index = np.cumsum(head) - 1
        sums = np.add.reduceat(n, first) if len(first) else n
        given = np.zeros(len(first), np.int64)
        np.maximum.at(given, index[of], whole[seen])
        sums = np.where(given > 0, given, sums)
        row = np.full(len(context), -1)
        row[np.flatnonzero(seen)] = of
        b, t, n3, _ = _summed(row[parent[seen3]], rank(last[seen3]), count3[seen3])
        width, self.size = len(vocabulary), len(c)
        self.width = U(width)
        pointers3 = np.searchsorted(b, np.arange(len(c) + 1))
        held = [
            EliasFano(c[first], 1 << 64),
            EliasFano(index.astype(U) * self.width + s.astype(U), max(1, len(first) * width)),
            EliasFano(np.append(first, len(c)).astype(U), len(c) + 1),
            EliasFano(vocabulary, 1 << 64),
            EliasFano(b.astype(U) * self.width + t.astype(U), max(1, len(c) * width)),
            EliasFano(pointers3.astype(U), len(b) + 1),
        ]
        codes = quantise(n / (sums[index] + mu))
        weights = quantise(mu / (n + mu))
        codes3 = quantise(n3 / (n[b] + mu)) if len(b) else np.zeros(0, np.uint8)
        self.levels = Levels(sum(x.nbytes() for x in held) + sum(len(x) + 64 for x in (codes, weights, codes3)))
        self.contexts, self.successors, self.pointers, self.words, self.lasts, self.pointers3 = (x.move(self.levels) for x in held)
        self.codes, self.weights, self.codes3 = (self.levels.put(x) for x in (codes, weights, codes3))

    def _child(self, level: EliasFano, pointers: EliasFano, parent: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Index in a level of each parent's successor, -1 where there is none."""
        out = np.full(len(parent), -1)
        some = np.flatnonzero(parent >= 0)
        if not len(some) or not level.n:
            return out
        distinct, of = np.unique(token[some].astype(U), return_inverse=True)
        rank, met = self.words.next_geq(distinct)
        rank, met = rank[of], met[of]
        some, rank = some[met], rank[met]
        at, same = level.next_geq(parent[some].astype(U) * self.width + rank.astype(U))
        some, at = some[same], at[same]
        inside = at < pointers.get(parent[some] + 1).astype(np.int64)
        out[some[inside]] = at[inside]
        return out

    def bigrams(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Index of each bigram, -1 for those that the trie does not hold."""
        if not self.contexts.n:
            return np.full(len(context), -1)
        distinct, of = np.unique(context, return_inverse=True)
        i, known = self.contexts.next_geq(distinct)
        return self._child(self.successors, self.pointers, np.where(known, i, -1)[of], successor)

    def trigrams(self, bigram: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Code of each trigram, below bigrams given by index; 0 for those that the trie does not hold."""
        out = np.zeros(len(bigram), np.uint8)
        at = self._child(self.lasts, self.pointers3, bigram, last) if self.lasts.n else np.full(len(bigram), -1)
        out[at >= 0] = self.codes3[at[at >= 0]]
        return out

    def codes_of(self, bigram: np.ndarray) -> np.ndarray:
        """Codes of bigrams by index, 0 for none."""
        return np.where(bigram >= 0, self.codes[bigram] if self.size else 0, 0).astype(np.uint8)

    def weights_of(self, bigram: np.ndarray) -> np.ndarray:
        """Codes of the weight that bigrams as contexts leave to shorter ones; all of it where there is none."""
        return np.where(bigram >= 0, self.weights[bigram] if self.size else 255, 255).astype(np.uint8)
