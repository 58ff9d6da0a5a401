"""Words and their hashes, in slices of any size, and the memory that a very long text takes."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gneiss.llm import jaccard, licences, lm, quality, suffixes, text


def packed(texts):
    return text.utf8(pa.array(texts))


@pytest.mark.parametrize("table", [text.WORD, text.ALNUM])
@pytest.mark.parametrize("limit", [1, 2, 7, 64, 1 << 20])
def test_slices_do_not_change_the_words(table, limit):
    rng = np.random.default_rng(limit)
    texts = ["", " ", None, "One two,three", "x" * 300, "a " * 100, "  tail", *("".join(rng.choice(list("aB ,\n\u00e9"), 80)) for _ in range(20)), ""]
    buf, offsets = packed(texts)
    h, rows = text.word_hashes(buf, offsets, table, limit)
    starts, ends, want = text.words(text.LOWER[buf], offsets, table)
    assert rows.tolist() == want.tolist()
    names = [text.LOWER[buf][a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(zip(names, h.tolist()))) == len(set(names)) == len(set(h.tolist()))


def big(n):
    rng = np.random.default_rng(1)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(5000)])
    return " ".join(words[rng.integers(0, 5000, n // 7)])[:n]


def test_memory_for_each_byte_of_a_long_text():
    """numpy's peak stays near some ten bytes a byte; the slices themselves take what slices take."""
    n = 12_000_000
    buf, offsets = packed([big(n)])
    model = quality.fit([np.zeros((2, quality.N_FEATURES), np.float32), np.ones((3, quality.N_FEATURES), np.float32)], np.array([0.0, 1.0]))
    column = pa.array([buf.tobytes().decode()])
    text._powers(1 << 20)
    for name, f in {
        "op3": lambda: list(jaccard._sets(column, 3)),
        "op5": lambda: licences._hashes(buf, offsets),
        "op6": lambda: lm._tokens(buf, offsets),
        "op8": lambda: [len(g) for _, _, _, _, g, _, _ in suffixes._sliced(buf, offsets, 200, 50)],
        "op10": lambda: quality.scores(model, column),
    }.items():
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 * n + (120 << 20), (name, peak / n)


def thue_morse(n):
    """Two words of n letters whose difference vanishes under polynomial hashes modulo powers of two."""
    w = [0]
    while len(w) < n:
        w += [1 - b for b in w]
    return "".join("ab"[b] for b in w[:n]), "".join("ba"[b] for b in w[:n])


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_patterned_words_are_told_apart(n):
    a, b = thue_morse(n)
    buf, offsets = packed([a, b])
    for table in (text.WORD, text.ALNUM):
        assert len(set(text.word_hashes(buf, offsets, table)[0].tolist())) == 2
    assert len(set(quality._line_hashes(buf, offsets[:-1], offsets[1:]).tolist())) == 2


def test_patterned_words_in_operators(spark):
    a, b = thue_morse(2048)
    df = spark.createDataFrame([(1, f"{a} one two three"), (2, f"{b} one two three"), (3, f"{a} {a} {b} three")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(df, k=3, percent=90).collect()} == {1: 1, 2: 2, 3: 3}
    bases = {r.doc_id: r.base_score for r in lm.score(df).collect()}
    assert bases[1] == bases[2] != bases[3]
