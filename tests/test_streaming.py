"""Stateless operators and running sketches on streams."""

from pyspark.sql import functions as F

from gneiss.plans.features import Feature, FeatureSchema
from gneiss.sources import csv, wire
from gneiss.streaming import stateless

SCHEMA = FeatureSchema((Feature("a", "INT"), Feature("b", "BYTES")))


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"select * from {name}")


def test_stateless(spark, tmp_path):
    lines = [f"{i},x{i}" for i in range(20)]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "csv"))
    out = stateless.stream_csv(spark.readStream.text(str(tmp_path / "csv")), "value", csv.CsvFormat(("a", "b")), SCHEMA)
    assert sorted((r.a[0], bytes(r.b[0])) for r in drained(out, "csv_out").collect()) == [(i, f"x{i}".encode()) for i in range(20)]
    recs = [(wire.build_example({"a": ("INT", [i])}),) for i in range(9)]
    spark.createDataFrame(recs, "record binary").write.parquet(str(tmp_path / "ex"))
    stream = spark.readStream.schema("record binary").parquet(str(tmp_path / "ex"))
    got = drained(stateless.stream_examples(stream, "record", SCHEMA), "ex_out").collect()
    assert sorted(r.a[0] for r in got) == list(range(9)) and all(r.b is None for r in got)
    spark.range(4).write.parquet(str(tmp_path / "n"))
    got = drained(stateless.stream_canonical(spark.readStream.schema("id long").parquet(str(tmp_path / "n"))), "n_out").collect()
    assert sorted(r.id for r in got) == [[0], [1], [2], [3]]


def test_running_distinct(spark, tmp_path):
    ids = spark.range(3000).select((F.col("id") % 700).alias("u"))
    ids.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateless.running_distinct(stream, "u", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert stateless.distinct_so_far(spark, str(tmp_path / "out")).first()[0] == 700


def test_windowed_counts(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = stateless.windowed_counts(e, "ts", "event_type").agg(F.sum("n")).first()[0]
    assert got == e.count()
