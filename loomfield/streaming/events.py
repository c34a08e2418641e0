"""Structured Streaming forms of the log operators, run to completion with availableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators.graph import shared_folder

def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; event time is a timestamp with a zone, as watermarks need."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if _is_folder(spark, path) else f"{path}*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(p)


def to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and read the result back."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def store(batch: DataFrame, batch_id: int) -> None:  # idempotent: a batch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).drop("batch")


def once_each(stream: DataFrame) -> DataFrame:
    """Each event id once within the watermark: the replay guard."""
    return stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])


def hourly(stream: DataFrame) -> DataFrame:
    """Events and value per hour and type."""
    return stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "value")


def latest_by_user(stream: DataFrame) -> DataFrame:
    """Newest event of each user: keyed state of one row a user."""
    b = F.max(F.struct("ts", "event_id", "event_type")).alias("b")
    return stream.groupBy("user_id").agg(b).select("user_id", F.col("b.event_id").alias("event_id"), F.col("b.event_type").alias("event_type"))
