"""Cutting lineage with tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, and only
    where that is unset and the master is local (tests on one machine) a folder under /tmp/checkpoints."""
    given = spark.conf.get(CHECKPOINT_KEY, None)
    if not given and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    return (given or "/tmp/checkpoints").rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the reread table.

    Unlike a cached frame the table survives the loss of any executor, and what is
    computed from it does not repeat the work above it. Shuffle files of the work above are
    deleted once the driver's JVM has collected their handles, so collection is asked for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brightline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more."""
    for df in tables:
        if df is not None:
            spark, path = df.sparkSession, df.written_to
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
