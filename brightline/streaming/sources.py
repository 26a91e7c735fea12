"""Streams over tables in files, and runs of a stream until all that is there has been read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.functions.materialise import shared_dir

#: A time past all others, at which the watermark closes what is still open.
END = "2200-01-01 00:00:00"


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the rows of a table: its files come in batches, new files are read as they appear."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern, as a table may be one file or a folder of them.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream gives until its input is read, with batch, the number of the batch; each batch is written once, whatever is tried again."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/brightline/stream-{name}-{uuid.uuid4().hex}"
    _run(stream, mode, at)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{at}/out")


def drained_and_closed(rows: DataFrame, time: str, steps: Callable[[DataFrame], DataFrame], mode: str, name: str) -> DataFrame:
    """As drained(), for steps on a stream of rows that hold something back until the watermark has passed it.

    When all files are read, the query goes on from its checkpoint with one more row, of nulls at a time past all others, and the watermark releases the rest. Steps
    must give nothing for that row itself but rows whose key is null.
    """
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/brightline/stream-{name}-{uuid.uuid4().hex}"
    last = spark.createDataFrame([()], "struct<>").select(*(F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in rows.schema))
    last.limit(0).write.parquet(f"{at}/last")
    stream = steps(rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{at}/last")))
    _run(stream, mode, at)
    last.write.mode("append").parquet(f"{at}/last")
    _run(stream, mode, at)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{at}/out")


def _run(stream: DataFrame, mode: str, at: str) -> None:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
