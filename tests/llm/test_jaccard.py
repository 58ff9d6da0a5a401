"""The Jaccard join against brute force."""

import random
import re

import pytest

from gneiss.llm import jaccard

from .fixtures import SF, edge_docs, empty_docs


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = sorted((len(s), i) for i, s in enumerate(sets) if s and rows[i][0] is not None)
    for x, (n, i) in enumerate(by):
        for m, j in by[x + 1 :]:
            if 100 * n < percent * m:
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (n + m - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choices(vocab, k=40))
    rows, doc = [], 10_000
    for family in range(12):
        base = rng.choices(vocab, k=rng.choice([5, 30, 200, 600]))
        for copy in range(rng.choice([1, 3, 25])):
            ws = list(base)
            for _ in range(rng.randrange(0, 1 + len(ws) // 40)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            text = " ".join(ws)
            rows.append((doc, text.upper() if rng.random() < 0.1 else f"{shared}\n{text}" if rng.random() < 0.3 else text))
            doc += 1
    return rows


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, percent):
    docs = edge_docs(spark).select("doc_id", "text", "word").unionByName(spark.createDataFrame([(*r, "x") for r in near_copies()], "doc_id long, text string, word string"))
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "'y' as word")).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in jaccard.join(docs, k, percent).collect()), key=repr)
    want = brute(rows, k, percent)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_blocks_agree(spark, monkeypatch):
    rows = near_copies(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    got = sorted((tuple(r) for r in jaccard.join(docs, 3, 90).collect()), key=repr)
    assert got == brute(rows, 3, 90)


def test_empty(spark):
    assert jaccard.join(empty_docs(spark)).count() == 0


def test_hot_shingles(spark, monkeypatch):
    """Near copies that share most of their prefixes, in blocks that meet two by two."""
    monkeypatch.setattr(jaccard, "MEMBERS", 7)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):
        ws = list(base)
        ws[rng.randrange(80)] = f"x{i % 40}"
        rows.append((i, " ".join(ws if i % 9 else rng.choices(base, k=80))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.join(docs, 3, 90).collect()), key=repr)
    assert got == brute(rows, 3, 90)
