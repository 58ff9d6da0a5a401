"""The Bloom filter never says no to a key that it holds."""

from gneiss.llm.bloom import maybe_in


def test_members_pass(spark):
    keys = spark.createDataFrame([(i * 7919,) for i in range(500)] + [(None,), (-5,)], "k long")
    test = maybe_in(keys, bits=1 << 14)
    got = spark.range(0, 5000).selectExpr("id * 7919 as k").withColumn("in", test("k")).collect()
    assert all(r["in"] for r in got[:500]) and sum(r["in"] for r in got[500:]) < 500
    assert spark.createDataFrame([(None,), (-5,)], "k long").select(test("k").alias("x")).collect() == [(False,), (True,)]
    nothing = maybe_in(keys.limit(0))
    assert not any(r.x for r in keys.select(nothing("k").alias("x")).collect())
