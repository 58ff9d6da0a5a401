"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: whole windows of max_len first, then the
binary digits of the rest, longest first. Pieces of one length form a bucket, and each piece is a sequence of its
own there. So no sequence crosses documents, and none needs padding: every length is a power of two.

The work is one narrow pass over the documents: no shuffle, nothing gathered, and a lost task is simply run again.

Null and empty texts have the closing id alone, one piece of length 1. Repeated rows are packed row by row.
An empty table gives an empty table; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .store import bounded_batches
from .text import lean

MAX_LEN = 2048
END_ID = 1
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
)


@lru_cache(maxsize=4)
def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE vocabularies use for bytes, by the published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    The vocabulary's ids follow the order of its merges, so a rank encoder over the same tokens gives equal ids
    several times as fast; texts that it can't take go to the tokenizers library. The file's added tokens are cut out of
    a text first, as the library does by default; those that match in a way of their own (whole words, stripped
    neighbours) send their text to the library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t for t in file.get("added_tokens", ())}
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in t): i for t, i in file["model"]["vocab"].items() if all(c in alphabet for c in t) and t not in added
        }
        self.path, self.slow = path, None
        self.added = {t: x["id"] for t, x in added.items()}
        self.odd = [t for t, x in added.items() if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        if any(t in text for t in self.odd):
            return self._library(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m.group()]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # the pattern engine gives up on some very long runs, with a panic
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        return self._library(text)

    def _library(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n ids."""
    out = [(i * max_len, max_len) for i in range(n // max_len)]
    at = n // max_len * max_len
    for bit in range(max_len.bit_length() - 2, -1, -1):
        if n % max_len >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    max_len: int = MAX_LEN,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of each document of docs(doc_id, text), with their ids if with_ids.

    max_len must be a power of two. sequence_id is (input partition, bucket, position in the bucket): unique, and the
    same when a task is run again on its input split.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    bounded_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        tok, filled = tokens(path), [0] * 64
        part = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1)
            rows: list[tuple] = []
            out_ids: list[np.ndarray] = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.append(tok.ids(texts[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                raw = memoryview(ids).cast("B")
                for start, length in pieces(len(ids), max_len):
                    k = length.bit_length() - 1
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    rows.append((doc, start, length, crc, len(ids), part | k << 34 | filled[k], 0, k))
                    filled[k] += 1
                    if with_ids:
                        out_ids.append(ids[start : start + length].astype(np.int32))
                if len(rows) >= 20_000:
                    yield emit(rows, out_ids)
                    rows, out_ids = [], []
            if rows:
                yield emit(rows, out_ids)

    def emit(rows, out_ids):
        cols = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.int32())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
        if with_ids:
            arrays.append(pa.array([list(x) for x in out_ids], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        lean(run), SCHEMA + (", ids array<int>" if with_ids else "")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
