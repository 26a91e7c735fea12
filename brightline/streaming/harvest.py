"""Incremental harvest: overlapping deliveries merged into an append-only table of revisions, whatever is delivered again or in another order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def harvest(stream: DataFrame, path: str, identity: list[str], content: list[str], time: str) -> None:
    """Reads what is new in stream and appends to the table at path each (identity, content) that it lacks; both survive a restart.

    A batch is compared with the days of the table that its own rows fall on, no others are read; so rows of one identity must keep their time. A batch that is
    tried again overwrites what it wrote. Columns: day, batch, those of the stream, and content_hash.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hashed = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
        rows = batch.withColumn("content_hash", hashed).withColumn("day", F.date_format(time, "yyyy-MM-dd")).dropDuplicates([*identity, "content_hash"])
        days = [r.day for r in rows.select("day").distinct().collect()]  # as many as the days of one batch's files
        known = table(spark, path, rows, days).where(F.col("batch") != number)
        same = F.lit(True)
        for c in [*identity, "content_hash"]:
            same = same & rows[c].eqNullSafe(known[c])
        new = rows.join(known, (rows["day"] == known["day"]) & same, "left_anti")
        new.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()


def table(spark: SparkSession, path: str, like: DataFrame, days: list[str] | None = None) -> DataFrame:
    """The rows harvested so far, of the given days or of all."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    schema = like.schema if "batch" in like.columns else like.withColumn("batch", F.lit(0).cast("long")).schema
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/data")
    return rows if days is None else rows.where(F.col("day").isin(days))


def revisions(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """version: the number of each revision of an identity, by order and then by content, not by when it was harvested."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(*identity).orderBy(*order, "content_hash")))
