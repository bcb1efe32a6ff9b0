"""Tables that grow with files dropped in a folder: an extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: list[str]):
    """Read what is new in a folder of JSON lines and add it to a parquet table, a folder per micro-batch; a
    batch that is run again replaces its own folder. Ends when everything present has been read."""

    def add(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: list[str]) -> DataFrame:
    """The row of each key from the latest batch."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*key, "x.*")
