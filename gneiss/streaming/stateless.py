"""Stateless operators on streams: the same functions, since they neither shuffle nor aggregate; and running sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.operators import relational
from gneiss.plans.features import FeatureSchema
from gneiss.sources import csv, examples


def stream_examples(records: DataFrame, column: str, schema: FeatureSchema) -> DataFrame:
    """C1 on a stream; the schema must be given, since a stream can't be read twice."""
    return examples.decode_examples(records, column, schema)


def stream_csv(lines: DataFrame, column: str, form: csv.CsvFormat, schema: FeatureSchema) -> DataFrame:
    """C6 on a stream of lines, by schema."""
    return csv.decode(lines, column, form, schema)


def stream_canonical(df: DataFrame) -> DataFrame:
    """P5 on a stream."""
    return relational.canonicalize(df)


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, key, n): counts by event-time window, late rows dropped behind the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def running_distinct(events: DataFrame, column: str, path: str, checkpoint: str, k: int = 4096) -> StreamingQuery:
    """G1 on a stream: each micro-batch leaves its theta sketch; the union of the files is the count so far.

    A batch that is run again overwrites its own file, so each is counted once.
    """

    def leave(batch: DataFrame, epoch: int) -> None:
        batch.agg(F.theta_sketch_agg(column, F.lit(12)).alias("sketch")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(leave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_so_far(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.theta_sketch_estimate(F.theta_union_agg("sketch")).alias("n_distinct"))
