"""Fill-in-the-middle against brute force, and its SQL."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gneiss.llm import fim

from .fixtures import SF, edge_docs, empty_docs


def expected(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(pre), len(mid), text, f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", len(pre), len(mid), text, f"<P>{pre}<S>{suf}<M>{mid}")


def lines_of(spark):
    texts = [
        None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb\nc", "\na\n\nb", "é\n漢字\n\U0001f600\n", "has <P> in it\nand more", "x<S>", "<M>\n<M>",
        "ends in <\nS>\n<", "<\n<P\n", "P>\n>S>\n<", "tab\tand\rcarriage\r\nline", " \n\x85\n", "l\n" * 40_000, "y" * 300_000 + "\n" + "z" * 1000,
    ]
    rows = [(100 * j + i, t) for i, t in enumerate(texts) for j in range(6)]
    rows += [(None, "without\nid\n"), (None, "without\nid\n"), (7, "twice\nthe same\n"), (7, "twice\nthe same\n"), (7, "another\n")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("rate,spm", [(100, 50), (30, 100), (0, 0)])
def test_transform_against_brute_force(spark, rate, spm):
    df, rows = lines_of(spark)
    got = sorted(map(repr, map(tuple, fim.transform(df, rate=rate, spm=spm).collect())))
    assert got == sorted(repr(expected(i, t, rate, spm)) for i, t in rows)


def test_texts_are_rebuilt(spark):
    df, rows = lines_of(spark)
    out = fim.transform(df)
    assert out.where(~fim.rebuilt(F.col("output"), F.col("form")).eqNullSafe(F.col("text"))).count() == 0
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_edge_rows_and_columns(spark):
    df = edge_docs(spark).withColumns({"key": F.lit("clash"), "copies": F.lit(0), "ordinal": F.lit(1), "n": F.lit(2), "a": F.lit(3)})
    got = sorted(map(repr, map(tuple, fim.transform(df).collect())))
    assert got == sorted(repr(expected(r.doc_id, r.text)) for r in df.collect())
    assert fim.transform(empty_docs(spark)).count() == 0


def test_sentinels_that_overlap_are_refused(spark):
    for bad in (("<P>", "<P><S>", "<M>"), ("aba", "<S>", "<M>"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            fim.transform(edge_docs(spark), sentinels=bad)


def test_documents_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fim.op11_fim_units(spark, SF)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.split("Initial Plan")[0].count("ReusedExchange") == 2


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = fim.op11_fim_units(spark, SF)
    want = con.execute(f"select {', '.join(df.columns)} from ({fim.OP11_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
