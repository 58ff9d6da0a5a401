"""BPE with word ends, each word contracted by a segment tree over the ranks of its adjacent pairs.

The leaves of a word's tree are its adjacent pairs: rank and place of those that can merge, infinity for others. An inner
node is the smaller of its two children, so the root is the leftmost pair of lowest rank. Merging it changes three
leaves (the pair itself and both beside it); each update walks up to the root. So a word of n symbols costs at most
3 n log n steps, however long it is, and the root says when no mergeable pair is left.

Texts are cut at ASCII white space first, which no normal form, pattern or added token of such a vocabulary reaches over.
The distinct pieces of some MB of text that aren't in a cache of bounded size are normalised and cut into words
together: ASCII here, others by the normaliser and pre-tokenizer of the vocabulary file. Words of up to WIDE symbols
are contracted side by side, as a forest of such trees in numpy arrays that all take a step at a time; longer ones each
by a tree of their own. Long pieces are cut further between characters of different classes, and texts are handled in
slices, their digests updated slice by slice. Decoding looks every id up in the vocabulary again.

Null and empty texts have no ids and decode to an empty text. Rows are encoded one by one, repeated ones too. An empty
table gives an empty table; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .packing import _byte_alphabet
from .store import bounded_batches
from .text import lean, utf8

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SLICE = 1 << 20  # bytes of a text that are handled at a time
PIECE = 1 << 15  # characters of a piece from which it is cut further
CACHE = 400_000  # pieces remembered
CACHED = 256  # bytes up to which a piece is remembered
NONE = 1 << 62  # a leaf whose pair can't merge

WIDE = 64  # symbols of a word up to which it is contracted beside others

#: The words of the vocabulary's pattern, as they are for lower-cased ASCII; line feeds part pieces.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")
WHITE = re.compile(r"\s")
SPACE = re.compile(rb"[\t-\r ]")
# places where neither a word, an added token nor a composed character can reach over
_MARK = r"!-&(-/:-@\[-`{}~"
CUTS = re.compile(rf"(?<=[0-9])(?=[!-~])|(?=[0-9])|(?<=[A-Za-z])(?=[{_MARK}])|(?<=[{_MARK}])(?=[A-Za-z])")


class PairTree:
    """Adjacent pairs of a word's symbols under a segment tree of the smallest rank."""

    def __init__(self, symbols, ranks: dict[int, int]):
        n = len(symbols)
        self.symbols, self.ranks, self.size = symbols, ranks, n - 1
        self.after, self.before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        self.tree = array("q", [NONE]) * (2 * self.size)
        for i in range(self.size):
            self.tree[self.size + i] = self._leaf(i)
        for i in range(self.size - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a < b else b

    def _leaf(self, i: int) -> int:
        j = self.after[i]
        if j > self.size:
            return NONE
        rank = self.ranks.get(self.symbols[i] << 32 | self.symbols[j])
        return NONE if rank is None else rank << 32 | i

    def _update(self, i: int, value: int) -> None:
        tree, at = self.tree, i + self.size
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            if other < value:
                value = other
            at >>= 1
            if tree[at] == value:
                return
            tree[at] = value

    def contract(self, merged: list[int]) -> list[int]:
        """Merges the root's pair until no pair can; the symbols that are left, in order."""
        tree, symbols, after, before, size = self.tree, self.symbols, self.after, self.before, self.size
        while tree[1] < NONE:
            rank, i = tree[1] >> 32, tree[1] & 0xFFFFFFFF
            j = after[i]
            symbols[i] = merged[rank]
            k = after[i] = after[j]
            if k <= size:
                before[k] = i
            if j < size:
                self._update(j, NONE)
            self._update(i, self._leaf(i))
            if before[i] >= 0:
                self._update(before[i], self._leaf(before[i]))
        out, i = [], 0
        while i <= size:
            out.append(symbols[i])
            i = after[i]
        return out


class Forest:
    """Trees as PairTree's for words of up to `leaves` pairs (a power of two), one row each, contracted in step."""

    def __init__(self, symbols: np.ndarray, leaves: int, keys: np.ndarray, ranks: np.ndarray):
        """symbols: words x (leaves + 2), -1 where a word has ended. keys: sorted pairs, left << 32 | right; ranks: theirs."""
        n = len(symbols)
        self.symbols, self.leaves, self.keys, self.ranks = symbols, leaves, keys, ranks
        self.bits = leaves.bit_length()
        self.after = np.tile(np.arange(1, leaves + 3, dtype=np.int32), (n, 1))
        self.before = np.tile(np.arange(-1, leaves + 1, dtype=np.int32), (n, 1))
        self.alive = symbols >= 0
        self.tree = np.full((n, 2 * leaves), NONE, np.int64)
        at = np.broadcast_to(np.arange(leaves), (n, leaves))
        self.tree[:, leaves:] = self._leaf(symbols[:, :leaves], symbols[:, 1 : leaves + 1], at)
        for i in range(leaves - 1, 0, -1):
            np.minimum(self.tree[:, 2 * i], self.tree[:, 2 * i + 1], out=self.tree[:, i])

    def _leaf(self, left, right, at) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        place = np.searchsorted(self.keys, pair)
        place[place == len(self.keys)] = 0
        return np.where((self.keys[place] == pair) & (right >= 0) & (left >= 0), self.ranks[place] << self.bits | at, NONE)

    def contract(self, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges roots until no pair can; the symbols left of all words, one after the other, and each word's number."""
        tree, symbols, after, before = self.tree, self.symbols, self.after, self.before
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            rank, i = root >> self.bits, root & ((1 << self.bits) - 1)
            j = after[live, i]
            symbols[live, i] = merged[rank]
            self.alive[live, j] = False
            k = after[live, i] = after[live, j]
            before[live, k] = i
            b = before[live, i]
            b = np.where(b < 0, i, b)  # the first symbol has no pair before it: its own is written twice
            tree[live, self.leaves + np.where(j < self.leaves, j, i)] = NONE
            two = np.concatenate([live, live])
            where = np.concatenate([b, i])
            tree[two, self.leaves + where] = self._leaf(symbols[two, where], symbols[two, after[two, where]], where)
            up = np.stack([i, np.where(j < self.leaves, j, i), b], 1) + self.leaves
            rows = live[:, None]
            for _ in range(self.bits - 1):
                up >>= 1
                tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
            live = live[tree[live, 1] < NONE]
        return symbols[self.alive], self.alive.sum(1)


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Codec(dict):
    """Ids of a vocabulary file of this kind: a cache from pieces (bytes) to their ids (little-endian 32-bit)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, end = file["model"], file["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or not end:
            raise ValueError(f"{path} is no BPE vocabulary with word ends")
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.merged_array = np.array(self.merged, np.int32)
        self.pair_keys = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in self.pair_keys.tolist()], np.int64)
        alphabet = _byte_alphabet()
        self.inner = {c: vocab[c] for c in alphabet}
        self.last = {c: vocab[c + end] for c in alphabet}
        self.byte_chars = {b: c for c, b in alphabet.items()}
        self.inner_codes, self.last_codes = np.zeros((2, 1 + max(map(ord, alphabet))), np.int32)
        for c in alphabet:
            self.inner_codes[ord(c)], self.last_codes[ord(c)] = self.inner[c], self.last[c]
        self.library = Tokenizer.from_file(path)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError(f"{path} has added tokens with rules of their own")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        strings = dict((i, t) for t, i in vocab.items()) | {i: t for t, i in self.added.items()}
        self.strings = [strings.get(i, "").encode() for i in range(max(strings) + 1)]

    def word(self, chars: str) -> list[int]:
        """Ids of one word, given in the byte alphabet."""
        symbols = [self.inner[c] for c in chars[:-1]] + [self.last[chars[-1]]]
        return symbols if len(symbols) == 1 else PairTree(symbols, self.ranks).contract(self.merged)

    def words(self, chars: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in the byte alphabet, one after the other, and where each begins (one more at the end)."""
        sizes = np.fromiter(map(len, chars), np.int64, len(chars))
        ends = np.cumsum(sizes)
        codes = np.frombuffer("".join(chars).encode("utf-32-le"), "<u4")
        flat = self.inner_codes[codes]
        flat[ends - 1] = self.last_codes[codes[ends - 1]]
        counts, found = sizes.copy(), []  # words of one symbol stay
        leaves, low = 1, 2
        while low <= WIDE:
            of = np.flatnonzero((sizes >= low) & (sizes <= min(WIDE, leaves + 1)))
            if len(of):
                table = np.full((len(of), leaves + 2), -1, np.int32)
                row = np.repeat(np.arange(len(of)), sizes[of])
                col = np.arange(len(row)) - np.repeat(np.cumsum(sizes[of]) - sizes[of], sizes[of])
                table[row, col] = flat[np.repeat(ends[of] - sizes[of], sizes[of]) + col]
                ids, counts[of] = Forest(table, leaves, self.pair_keys, self.pair_ranks).contract(self.merged_array)
                found.append((of, ids))
            low, leaves = leaves + 2, leaves * 2
        for i in np.flatnonzero(sizes > WIDE):
            ids = np.array(PairTree(flat[ends[i] - sizes[i] : ends[i]].tolist(), self.ranks).contract(self.merged), np.int32)
            counts[i] = len(ids)
            found.append((np.array([i]), ids))
        begins = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(begins[-1], np.int32)
        one = np.flatnonzero(sizes == 1)
        out[begins[one]] = flat[ends[one] - 1]
        for of, ids in found:
            col = np.arange(len(ids)) - np.repeat(np.cumsum(counts[of]) - counts[of], counts[of])
            out[np.repeat(begins[of], counts[of]) + col] = ids
        return out, begins

    def _words(self, piece: str):
        """Words of a piece without added tokens, in the byte alphabet."""
        if piece.isascii():
            return (w.translate(self.byte_chars) for w in ASCII_WORDS.findall(piece.lower()))
        return (w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece)))

    def _segments(self, piece: str):
        if len(piece) <= PIECE:
            yield piece
            return
        at = 0
        for m in CUTS.finditer(piece):
            if m.start() - at >= PIECE:
                yield piece[at : m.start()]
                at = m.start()
        yield piece[at:]

    def encode(self, piece: str) -> bytes:
        """Ids of any piece that holds no ASCII white space."""
        out, at = array("I"), 0
        for m in [*(self.cut.finditer(piece) if self.cut else ()), None]:
            for part in self._segments(piece[at : m.start() if m else None]):
                for w in self._words(part):
                    out.extend(self.word(w))
            if m:
                out.append(self.added[m.group()])
                at = m.end()
        return np.array(out, "<u4").tobytes()

    def learn(self, pieces: list[bytes]) -> None:
        """Puts the ids of short pieces without added tokens into the cache, all at once."""
        ascii_, others = [], []
        for p in pieces:
            if len(p) <= CACHED:
                text = p.decode()
                if self.cut and self.cut.search(text):
                    continue
                if text.isascii():
                    ascii_.append(p)
                elif not WHITE.search(text):
                    others.append(p)
        number, spelled, of = Numbers(), [], []  # distinct words, the words met, and the piece of each
        if ascii_:
            met = np.array(list(map(number.__getitem__, ASCII_WORDS.findall(b"\n".join(ascii_).decode().lower()))), np.int64)
            end = met == number["\n"]
            spelled.append(met[~end])
            of.append(np.cumsum(end)[~end])
        unspelled = len(number)
        if others:
            text = self.library.normalizer.normalize_str(b" ".join(others).decode())
            found = self.library.pre_tokenizer.pre_tokenize_str(text)
            spaces = np.array([m.start() for m in re.finditer(" ", text)], np.int64)
            # a mark keeps these apart from words of ASCII pieces, which aren't in the byte alphabet yet
            spelled.append(np.array([number["\n" + w] for w, _ in found], np.int64))
            of.append(np.searchsorted(spaces, np.array([at for _, (at, _) in found], np.int64)) + len(ascii_))
        if not number:
            return
        words = [w.translate(self.byte_chars) if i < unspelled else w[1:] for i, w in enumerate(number)]
        ids, begins = self.words(words)
        spelled, of = np.concatenate(spelled), np.concatenate(of)
        sizes = (begins[1:] - begins[:-1])[spelled]
        col = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = ids[np.repeat(begins[spelled], sizes) + col].astype("<u4").tobytes()
        known = ascii_ + others
        at = (4 * np.concatenate([[0], np.cumsum(np.bincount(of, sizes, len(known)))]).astype(np.int64)).tolist()
        for i, p in enumerate(known):
            self[p] = flat[at[i] : at[i + 1]]

    def __missing__(self, piece: bytes) -> bytes:
        return self.encode(piece.decode())

    def groups(self, texts):
        """For (row, bytes) in order of rows: lists of (row, pieces) of about SLICE bytes in all; long texts in slices."""
        group, held = [], 0
        for row, text in texts:
            at = 0
            while at < len(text):
                end = min(len(text), at + SLICE)
                if end < len(text):
                    space = SPACE.search(text, end)
                    end = space.start() if space else len(text)
                group.append((row, (text if end - at == len(text) else text[at:end]).split()))
                held += end - at
                at = end
                if held >= SLICE:
                    yield group
                    group, held = [], 0
        if group:
            yield group

    def encoded(self, texts):
        """(row, ids) in order of rows; a long text comes in several."""
        for group in self.groups(texts):
            if len(self) > CACHE:
                self.clear()
            self.learn(list(set().union(*(pieces for _, pieces in group)).difference(self)))
            for row, pieces in group:
                yield row, np.frombuffer(b"".join(map(self.__getitem__, pieces)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The vocabulary's strings of ids, parted by spaces: such a file has no decoder of its own."""
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, full: bool = False) -> DataFrame:
    """Number of ids and digests of ids and decoded text for docs(doc_id, text); with full also ids and decoded."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        c = codec(path)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            sums = [[0, hashlib.sha256(), hashlib.sha256()] for _ in range(batch.num_rows)]
            kept, words = [[np.zeros(0, np.int32)] for _ in sums], [[] for _ in sums]
            for row, ids in c.encoded((i, buf[off[i] : off[i + 1]].tobytes()) for i in range(batch.num_rows)):
                if len(ids):
                    one, decoded = sums[row], c.decode(ids)
                    one[1].update(ids)
                    one[2].update(b" " + decoded if one[0] else decoded)
                    one[0] += len(ids)
                    if full:
                        kept[row].append(ids.astype(np.int32))
                        words[row].append(decoded)
            rows = [(n, x.hexdigest(), y.hexdigest(), np.concatenate(kept[i]) if full else None, b" ".join(words[i]).decode()) for i, (n, x, y) in enumerate(sums)]
            n, ids_hex, text_hex, ids, decoded = zip(*rows) if rows else [()] * 5
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(lean(run), SCHEMA + (", ids array<int>, decoded string" if full else ""))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
