"""Streaming forms: the row functions work on streams as they are; these add state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.core.storage import shared_dir
from presswork.operators.series import trend_score, value_anomalous


def windowed_counts(events: DataFrame, topic: str = "topicId", time: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(topicId, date, count) per tumbling window; rows later than the watermark are dropped."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), topic).agg(F.count("*").alias("count"))
    return counted.select(F.col(topic).alias("topicId"), F.col("window.start").alias("date"), "count")


def scored_counts(counts: DataFrame, baselines: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Windowed counts against a static table (topicId, mean, stdDev) of rounded baselines."""
    joined = counts.join(baselines, "topicId")
    return joined.withColumn("t", trend_score(F.col("count").cast("double"), F.col("mean"), F.col("stdDev"), sigma)).select(*counts.columns, "t.*")


def counted_so_far(spark: SparkSession, path: str, schema: str, topic: str, time: str = "ts", width: str = "1 day") -> DataFrame:
    """(topicId, date, count) of all Parquet files that ``path`` names by now, read as a stream to its end.

    Every batch rewrites the table of totals in the shared folder; state and progress lie
    there too, so a lost executor costs a batch.
    """
    at = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).parquet(path)
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    totals = windowed_counts(events, topic, time, width, "3650 days")
    written: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/totals-{number}")
        written.append(f"{at}/totals-{number}")

    query = totals.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(totals.schema).parquet(written[-1]) if written else spark.createDataFrame([], totals.schema)


__all__ = ["counted_so_far", "scored_counts", "value_anomalous", "windowed_counts"]
