"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a master of local[..] gets a folder of its own; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def persisted(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lost executors never recompute what is before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kind = df.schema
    del df
    # shuffles behind the table are of no more use; Spark removes their files once the driver's garbage is collected, and
    # its scheduler forgets the last job when there is another
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(kind).parquet(path)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """From here on the session hands Python workers at most this much text at a time (and one row at least).

    Text operators call it. The default, ten thousand rows or 64 MB, is several times as much in the copies that the
    JVM and the worker hold. The setting only says how rows are batched; it stays, since plans are run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
