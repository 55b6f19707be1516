"""Coverage rows for new features as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.operators.control import first_rows
from zonalspark.operators.spatial import covered


def coverage_run(spark: SparkSession, source: str, datasets: DataFrame, target: str, files: int = 1) -> DataFrame:
    """All feature files (Parquet: geom_id and box) of a folder as one available-now run of `files` files a batch: geom_id,
    dataset_id of each dataset whose box holds the feature.

    A batch writes a folder of its own number, so one that runs again writes the same rows over; a feature that is delivered
    more than once, in one batch or in several, has its rows once, those of the last batch. Features are joined to the static
    datasets by grid cells."""
    schema = spark.read.option("recursiveFileLookup", True).parquet(source).schema

    def write(batch: DataFrame, number: int) -> None:
        rows = covered(batch.dropDuplicates(["geom_id"]), datasets)
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/rows/{number:08d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(source)
    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.option("recursiveFileLookup", True).schema("geom_id long, dataset_id long, batch int").parquet(f"{target}/rows")
    return first_rows(found, ["geom_id", "dataset_id"], [F.desc("batch")]).drop("batch")
