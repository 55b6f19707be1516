"""Streaming forms: counts by day with a watermark, and the task queue's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def day_counts(events: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """Events a day and kind; days close once the watermark has passed them. State is bounded by the open days."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(spark: SparkSession, source: str, target: str, pattern: str = "events.parquet") -> DataFrame:
    """All of a folder's events through day_counts, as one available-now run. Each batch writes the days that it changed,
    a batch that runs again writes them over; of each day the last batch holds."""
    from zonalspark.operators.control import first_rows

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/days/batch={number}")

    schema = spark.read.parquet(f"{source}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    run = day_counts(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return first_rows(spark.read.parquet(f"{target}/days"), ["window", "event_type"], [F.desc("batch")]).drop("batch")


def merge_batch(target: str, keys: list[str], order: str):
    """A foreachBatch function that keeps the newest row of each key in a Parquet table, written beside and switched by
    a version folder, so a failed batch leaves the last version whole."""

    def merge(batch: DataFrame, number: int) -> None:
        from zonalspark.operators.control import first_rows

        spark, last = batch.sparkSession, f"{target}/v{number - 1}"
        rows = batch if number == 0 else spark.read.parquet(last).unionByName(batch)
        first_rows(rows, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{target}/v{number}")

    return merge
