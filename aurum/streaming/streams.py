"""Micro-batch merge and windowed counts over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that is there now, in micro-batches; the checkpoint makes a restart go on where it stopped."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_values(spark: SparkSession, path: str, schema, store: str, checkpoint: str, entity: list[str], order: list[str], value: str) -> DataFrame:
    """The stream's latest value of each leaf. A batch's state is a version folder of its own, written whole, so that a batch
    that runs again writes the same folder; the batch before it is found in the store, also after a restart."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(below: int | None = None) -> str | None:
        """The last finished version, or the last one before a batch."""
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS"))]
        numbers = [n for n in numbers if below is None or n < below]
        return f"{store}/v{max(numbers)}" if numbers else None

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*entity, *order, value)
        if before := version(number):
            rows = rows.unionByName(spark.read.parquet(before))
        state = rows.groupBy(*entity).agg(F.max_by(F.struct(*order, value), F.struct(*order)).alias("s")).select(*entity, "s.*")
        state.write.mode("overwrite").parquet(f"{store}/v{number}")

    run_available(spark.readStream.schema(schema).parquet(path), merge, checkpoint)
    if last := version():
        return spark.read.parquet(last)
    return spark.createDataFrame([], spark.read.schema(schema).parquet(path).select(*entity, *order, value).schema)


def windowed_counts(spark: SparkSession, path: str, schema, ts: str, group: str, size: str, late: str, store: str) -> DataFrame:
    """Tumbling counts with a watermark, run to the end of what is there, as a finished table below store. Each batch adds the
    windows that it changed; the last count of a window counts, so that a batch that runs again changes nothing."""
    stream = spark.readStream.schema(schema).parquet(path).withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counts = stream.groupBy(F.window("_at", size).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), group, "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/counts/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{store}/counts").parquet(f"{store}/counts")
    return rows.groupBy("start", group).agg(F.max_by("n", "batch").alias("n"))
