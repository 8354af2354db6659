"""Event-time windows over streams: an addition, as the batch engine has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str = "ts", length: str = "1 day", late: str = "2 days", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, keys, events and value sums of tumbling windows; a stream drops what is later than ``late``."""
    e = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    d = e.groupBy(F.window("_at", length).alias("w"), *by).agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(38,4)").alias("value"))
    return d.select(F.col("w.start").alias("start"), *by, "events", "value")


def run_once(spark: SparkSession, source: str, target: str, checkpoint: str, **options: str) -> DataFrame:
    """Reads what Parquet files are there as a stream, and writes windows as they stand after it."""
    schema = spark.read.parquet(source).schema
    # a pattern, which may name a file as well as a folder
    stream = spark.readStream.schema(schema).parquet(f"{source[:-1]}[{source[-1]}]")
    writer = windowed(stream, **options).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.parquet(target)
