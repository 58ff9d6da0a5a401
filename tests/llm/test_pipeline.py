"""The pipeline's stages against brute force on a generated table."""

import corpus_pipeline as p
from pyspark.sql import functions as F
from gneiss.llm import quality

from .fixtures import SF
from .test_jaccard import brute as components
from .test_suffixes import brute as removed


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality_filter(spark, docs, SF)
    assert kept.schema == docs.schema
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good and 0 < len(good) < docs.count()

    once = p.near_duplicates(spark, kept, SF)
    assert once.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    want = {d for d, _, c in components(rows, 5, 80) if c == d}
    assert {r.doc_id for r in once.collect()} == want and len(want) < len(good)

    clean = p.repeated_passages(spark, once, SF)
    assert clean.columns == docs.columns
    before = once.orderBy("doc_id").collect()
    gone = removed([r.text for r in before], 200)
    after = {r.doc_id: r for r in clean.collect()}
    for r, (n, cut, _, _) in zip(before, gone):
        if cut < n or not n:
            size = len((after[r.doc_id].text or "").encode())
            assert n - cut <= size <= n - cut + 6 * (cut > 0)  # whole characters only
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            assert r.doc_id not in after
    assert sum(cut for _, cut, _, _ in gone) > 0

    packed = p.pack_sequences(spark, clean, SF)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_run(spark):
    assert p.run(spark, SF).count() > 100


def test_edges(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, no rows: nothing is lost unduly."""
    from .fixtures import edge_docs, empty_docs

    docs = edge_docs(spark).withColumn("runs", F.lit(1)).withColumn("t1", F.lit("x")).withColumn("score", F.lit(None).cast("double"))
    labels = spark.createDataFrame([(4, 1), (5, 1), (13, 0), (None, 0)], "doc_id long, quality int")
    kept = quality.keep(docs, quality.learn(docs, labels, held_out=None), 0.0)
    assert kept.schema == docs.schema and kept.count() == docs.count()
    once = p.near_duplicates(spark, kept, SF)
    assert once.columns == docs.columns
    ids = [r.doc_id for r in once.collect()]
    # 9 and 10 are copies; the null id and the texts without words stay
    assert sorted(ids, key=str) == sorted([i for i in [r.doc_id for r in docs.collect()] if i != 10], key=str)
    clean = {r.doc_id: r for r in p.repeated_passages(spark, once, SF).collect()}
    assert clean[1].text is None and clean[1].n_chars is None and clean[2].text == "" and clean[9].runs == 1 and clean[9].t1 == "x"
    assert 7 not in clean and 13 not in clean  # one character, one word over and over
    assert clean[8].text.startswith("é ß 漢字")
    packed = p.pack_sequences(spark, once, SF)
    assert packed.where("doc_id is null").count() > 0
    for f in (p.near_duplicates, p.repeated_passages, p.pack_sequences):
        assert f(spark, empty_docs(spark), SF).count() == 0
    twice = docs.where("doc_id = 9").unionAll(docs.where("doc_id = 9"))
    assert p.near_duplicates(spark, twice, SF).count() == 2 and p.repeated_passages(spark, twice, SF).count() == 2
