"""Pixels that arrive while a scan is running, as streams of (channel, y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PIXELS = "channel int, y int, x int, v int"


def arriving(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """The pixels of Parquet files as they appear in a folder."""
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def block_sums(pixels: DataFrame, factor: int) -> DataFrame:
    """(channel, y, x, total, n) of blocks so far: the state is one row a block, whatever has come."""
    where = [F.col("channel"), *[F.expr(f"{c} div {factor}").cast("int").alias(c) for c in "yx"]]
    return pixels.groupBy(*where).agg(F.sum("v").alias("total"), F.count("v").alias("n"))


def finished_blocks(pixels: DataFrame, factor: int) -> DataFrame:
    """(channel, y, x, v): means of the blocks of which all pixels have come."""
    full = block_sums(pixels, factor).filter(F.col("n") == factor * factor)
    return full.select("channel", "y", "x", F.rint(F.col("total") / F.col("n")).cast("int").alias("v"))


def write_finished(blocks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write blocks as they finish, each batch to its own folder, so that a batch done again after a loss replaces itself."""

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    return blocks.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
