"""Streams: queries against an index, and append-only growth with refresh of what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exact import knn
from ..operators.layout import touched


def stream_knn(spark: SparkSession, source: str, base: DataFrame, sink: str, checkpoint: str, k: int = 10, metric: str = "l2") -> DataFrame:
    """Answers every query that has arrived in a folder of Parquet files (vec_id, embedding), once each."""
    schema = "vec_id long, embedding array<float>, label int"
    arriving = spark.readStream.schema(schema).parquet(source)

    def answer(batch: DataFrame, number: int) -> None:
        knn(batch, base, k, metric).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    arriving.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).drop("batch")


def refresh_plan(batch: DataFrame, edges: DataFrame, high_water: int) -> DataFrame:
    """Records that a batch of vectors touches: new ones are those above the largest id known before."""
    return touched(batch.where(batch.vec_id > high_water), edges)


def stream_peaks(spark: SparkSession, source: str, sink: str, checkpoint: str, late: str = "2 days") -> DataFrame:
    """(day, process, peak, samples) of samples (ts, process, value) that arrive in a folder. A day is given out when the watermark
    has passed it; days still open when the source ends are given out with what came."""
    arriving = spark.readStream.schema("ts timestamp, process long, value double").parquet(source).withWatermark("ts", late)
    days = arriving.groupBy(F.window("ts", "1 day"), "process").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("samples"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "process", "peak", "samples", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{sink}/{number}")

    days.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(sink)
    last = F.max_by(F.struct("peak", "samples"), "batch").alias("x")
    return rows.groupBy("day", "process").agg(last).select("day", "process", "x.peak", "x.samples")
