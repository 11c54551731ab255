"""Incremental builds as a stream of files: each new file's chunks are checked once against what is accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.dedup import dedup_incremental


def run(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "chunk_id string, content string") -> None:
    """Take all files of `source` that no run before has taken, and append the first rows of new contents to `target`.

    The stream's checkpoint holds which files were taken, so a build that broke off goes on where it was. A
    batch is written to its own folder, so one that runs again replaces what it left behind.
    """

    def add(batch: DataFrame, number: int) -> None:
        try:
            seen = spark.read.parquet(target).where(F.col("batch") != number).select("hash")
        except Exception as e:  # nothing accepted yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = spark.createDataFrame([], "hash string")
        kept, _ = dedup_incremental(batch, "content", ["chunk_id"], seen)
        kept.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
