"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined, in Spark, with the positions of the same k-grams in the
license templates: pairs of words for short notices, five words for the bodies of licences, whose pairs ("of the") would hit
ordinary prose everywhere. A hit votes for the diagonal (position in the text minus position in the template). Hits of a
document and template that follow each other in both, on the same or neighbouring diagonals, are chained, so a few
inserted or dropped words don't split a span; a chain's votes are the different template positions that it hits.

A chain with enough votes is verified: its words are compared with the template's. Each hit carries the hashes of the
words ahead of it, from which the words between hits and after the last one are matched in order. Words that tell one
licence from another (names, versions) must all be matched, no inserted word may be a qualifier that names another
licence ("lesser", "sharealike", another number), and enough of the span's own words must be the template's.

The phrases of the base contract are templates of their own whose k-grams must all be hit on one diagonal: their
places are then exactly the places where the words stand consecutively. Words are compared by 64-bit hashes.

The template table has a fixed size (some hundred rows), so broadcasting it is safe whatever the input is. k-grams that
are not in it are left out before they reach the join. Only hits are shuffled, and one row per document. A text's hits for
one template are held at a time.

Null and empty texts have no words and no labels. Rows are scanned one by one, repeated ids too. An empty table
gives an empty table; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches
from .text import ALNUM, chunks, utf8, word_hashes

K, K_BODY = 2, 5  # words of a k-gram, of notices and of bodies
BODY = 40  # words from which a template is a body
GAP = 3  # hits whose diagonals are this near to each other can follow each other in a span
LEAP = 8  # template positions from one hit of a span to the next, at most
AHEAD = LEAP + GAP + K_BODY  # words that a hit carries, from its own first one on
SHARE = 0.6  # of a template's k-grams that a span must hit, and of a span's words that must be the template's

#: Phrases of the base contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Labels of the method's own: short notices as they are commonly written.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "released under the mit license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
}

#: Standard texts of licences and of the notices that they ask for.
BODIES = {
    "mit-text": """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial
portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to
the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or
in connection with the software or the use or other dealings in the software
""",
    "isc-text": """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims
all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the
author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
performance of this software
""",
    "bsd-text": """
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution
""",
    "bsd-warranty": """
this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not
limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the
copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including
but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused
and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out
of the use of this software even if advised of the possibility of such damage
""",
    "apache-2.0-text": """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express
or implied see the license for the specific language governing permissions and limitations under the license
""",
    "gpl-text": """
this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation either version 3 of the license or at your option any later version this program is
distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
fitness for a particular purpose see the gnu general public license for more details
""",
    "mpl-2.0-text": """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
file you can obtain one at http mozilla org mpl 2 0 or https mozilla org mpl 2 0
""",
    "unlicense-text": """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
in the software to the public domain
""",
}

NUMBERS = [str(i) for i in range(100)]
#: Words of a notice that a span must have, each time that they stand there; of a body, only the numbers.
TELLING = {*NUMBERS, *"apache gnu general public mit cc by nc creative commons attribution redistribution binary permission granted charge".split()}
#: Words that make another licence of a template when they are inserted.
QUALIFIERS = {*NUMBERS, *"lesser library affero nc noncommercial non commercial sa sharealike share alike nd noderivatives noderivs no derivatives font".split()}

MOST = 50_000  # words of all templates

SENTINEL = -(2**63)  # stands for a document's own row; no k-gram keeps this hash


def _hashes(buf, offsets):
    """Hashes of all words (int64), their positions in their rows, their rows, and the number of words of each row."""
    h, rows = word_hashes(buf, offsets, ALNUM)
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    return h, np.arange(len(h)) - (np.cumsum(n_words) - n_words)[rows], rows, n_words


def _grams(h, pos, rows, k: int):
    """k-gram hashes (int64), their word positions and rows."""
    if len(h) < k:
        return np.zeros(0, np.int64), pos[:0], rows[:0]
    n = len(h) - k + 1
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0xD1342543DE82EF95) + h[j : n + j]
    keep = rows[:n] == rows[k - 1 :]
    g = g.view(np.int64)[keep]
    g[g == SENTINEL] += 1
    return g, pos[:n][keep], rows[:n][keep]


def size_of_grams(text: str) -> int:
    return K_BODY if len(text.split()) >= BODY else K


def template_rows(templates: dict[str, str]) -> list[tuple[int, int, int]]:
    """(hash, template number, position) of each k-gram; the document row's hash comes last."""
    out = []
    for i, text in enumerate([*PHRASES, *templates.values()]):
        g, pos, _ = _grams(*_hashes(*utf8(pa.array([text])))[:3], size_of_grams(text))
        out += [(int(a), i, int(c)) for a, c in zip(g, pos)]
    return out + [(SENTINEL, -1, 0)]


def word_table(texts) -> list[list[int]]:
    """The hashes of the words of each text."""
    h, _, _, n_words = _hashes(*utf8(pa.array(list(texts))))
    return [x.tolist() for x in np.split(h.view(np.int64), np.cumsum(n_words)[:-1])]


class Verifier:
    """Finds and verifies the spans of one template among a text's hits."""

    def __init__(self, text: str):
        self.words, self.k = word_table([text])[0], size_of_grams(text)
        self.need = len(self.words) - self.k + 1
        self.telling = {h for (h,) in word_table(sorted(TELLING) if self.k == K else NUMBERS)} & set(self.words)
        self.other = {h for (h,) in word_table(sorted(QUALIFIERS))} - set(self.words)

    def spans(self, hits: list[tuple[int, int, bytes]]) -> list[tuple[int, int, float]]:
        """(first word, last word, share of the template's k-grams) of each span; hits(pos, at, words ahead) are sorted."""
        votes, before = [1] * len(hits), [-1] * len(hits)
        for i, (pos, at, _) in enumerate(hits):
            j = i - 1
            while j >= 0 and pos - hits[j][0] <= LEAP + GAP:
                p, a, _ = hits[j]
                if p < pos and a < at <= a + LEAP and abs((pos - at) - (p - a)) <= GAP and votes[j] >= votes[i]:
                    votes[i], before[i] = votes[j] + 1, j
                j -= 1
        out, used = [], bytearray(len(hits))
        for i in sorted((i for i in range(len(hits)) if votes[i] >= SHARE * self.need), key=lambda i: (-votes[i], i)):
            chain, j = [], i
            while j >= 0:
                chain.append(j)
                j = before[j]
            if any(used[j] for j in chain):
                continue
            end = self.verified([hits[j] for j in reversed(chain)])
            if end is not None:
                out.append((hits[chain[-1]][0], end, votes[i] / self.need))
                a, b = bisect_left(hits, (out[-1][0],)), bisect_left(hits, (end + 1,))
                used[a:b] = b"\1" * (b - a)
        return sorted(out)

    def verified(self, chain) -> int | None:
        """The last word of a chain of hits, or None if its words are not the template's."""
        met, inserted, k = set(), [], self.k
        for (pos, at, ahead), (p, a, _) in zip(chain, [*chain[1:], (None, None, None)]):
            met.update(range(at, at + k))
            ahead = np.frombuffer(ahead, np.int64).tolist()
            if p is None:  # what is left of the template may follow without making a k-gram
                a = len(self.words)
                text = ahead[k : a - at + GAP]
            elif p - pos < k:  # a word of the text stands for one of the template only
                if a - at > p - pos:
                    met.difference_update(range(at + p - pos, at + k))
                continue
            else:
                text = ahead[k : p - pos]
            left, last = [], 0
            for i in range(at + k, a):
                if self.words[i] in text[last:]:
                    j = text.index(self.words[i], last)
                    left += text[last:j]
                    last = j + 1
                    met.add(i)
            inserted += left if p is None else left + text[last:]
        end = pos + k - 1 + last
        if self.other.intersection(inserted) or any(w in self.telling for i, w in enumerate(self.words) if i not in met):
            return None
        return end if len(met) >= SHARE * (end - chain[0][0] + 1) else None


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): words, base places and labels, and the spans found by the templates.

    templates maps labels to texts, by default the short notices of TEMPLATES and the texts of BODIES. At most MOST words of them are taken, which
    bounds what is broadcast.
    """
    templates = TEMPLATES | BODIES if templates is None else templates
    if sum(len(x.split()) for x in templates.values()) > MOST:
        raise ValueError(f"templates hold more than {MOST} words")
    spark = docs.sparkSession
    bounded_batches(spark)

    table = template_rows(templates)
    known = np.unique([g for g, _, _ in table])

    def grams(batches):
        uid, part = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            buf, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                off = offsets[i : j + 1]
                h, places, of, n_words = _hashes(buf[off[0] : off[-1]], off - off[0])
                parts = []
                for k in (K, K_BODY):
                    g, pos, rows = _grams(h, places, of, k)
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g)
                    parts.append((g[hit], pos[hit], rows[hit]))
                g, pos, rows = (np.concatenate(x) for x in zip(*parts))
                h = h.view(np.int64)
                ends = np.cumsum(n_words)
                at = (ends - n_words)[rows] + pos
                h = np.append(h, 0)
                key = part + uid + np.arange(j - i)
                # a text's own row carries its id and its number of words; k-grams carry neither
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), ids.slice(i, j - i), pa.array(n_words.astype(np.int64)), pa.array(np.full(j - i, SENTINEL)), pa.nulls(j - i, pa.binary())],
                    ["uid", "doc_id", "pos", "gram", "ahead"],
                )
                for a in range(0, len(g), 1 << 15):
                    b = min(len(g), a + (1 << 15))
                    w = at[a:b, None] + np.arange(AHEAD)
                    ahead = h[np.where(w < ends[rows[a:b], None], w, len(h) - 1)]
                    size = pa.py_buffer(np.arange(b - a + 1, dtype=np.int32) * (8 * AHEAD))
                    ahead = pa.Array.from_buffers(pa.binary(), b - a, [None, size, pa.py_buffer(np.ascontiguousarray(ahead))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[rows[a:b]]), pa.nulls(b - a, pa.int64()), pa.array(pos[a:b].astype(np.int64)), pa.array(g[a:b]), ahead],
                        ["uid", "doc_id", "pos", "gram", "ahead"],
                    )
                uid += j - i

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        grams, "uid long, doc_id long, pos long, gram long, ahead binary"
    )
    table = spark.createDataFrame(table, "gram long, template int, at int")
    hits = rows.join(F.broadcast(table), "gram")

    n_phrases = len(PHRASES)
    size = [max(1, len(x.split()) - K + 1) for x in PHRASES]

    def verify(batches):
        verifiers = [Verifier(x) for x in templates.values()]

        def found():
            every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            for (uid, template), group in groupby(every, lambda row: row[:2]):
                if template < 0:
                    yield from ((uid, doc_id, template, None, pos, None) for _, _, pos, _, doc_id, _ in group)
                elif template < n_phrases:
                    votes = {}
                    for _, _, pos, at, _, _ in group:
                        votes[pos - at] = votes.get(pos - at, 0) + 1
                    yield from ((uid, None, template, 1.0, d, d + size[template]) for d, n in votes.items() if n == size[template])
                else:
                    for first, end, share in verifiers[template - n_phrases].spans([(row[2], row[3], row[5]) for row in group]):
                        yield uid, None, template, share, first, end

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
        names, out = ["uid", "doc_id", "template", "share", "first", "end"], []
        for row in found():
            out.append(row)
            if len(out) == 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    spans = (
        hits.select("uid", "template", "pos", "at", "doc_id", "ahead")
        .repartition("uid")
        .sortWithinPartitions("uid", "template", "pos", "at")
        .mapInArrow(verify, "uid long, doc_id long, template int, share double, first long, end long")
    )
    label = F.when(F.col("template") >= 0, F.element_at(F.lit([*PHRASES.values(), *templates]).cast("array<string>"), F.col("template") + 1))
    base = (F.col("template") >= 0) & (F.col("template") < n_phrases)
    return (
        spans.withColumn("label", label)
        .withColumn("base", base)
        .groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max(F.when(F.col("template") < 0, F.col("first"))).alias("n_words"),
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.col("label"))), ",").alias("labels"),
            F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("share"))), F.lit(0.0)).alias("score"),
            F.count_if((F.col("template") >= n_phrases)).alias("n_spans"),
            F.min(F.when(F.col("template") >= n_phrases, F.col("first"))).alias("first_span"),
            F.max(F.when(F.col("template") >= n_phrases, F.col("end"))).alias("last_span_end"),
        )
        .drop("uid")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
