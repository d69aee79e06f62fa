"""Trends and anomalies of counted series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.core.jscompat import round0, round2


def mean(value: Column) -> Column:
    """Aggregate; 0 for no rows."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def stddev(value: Column) -> Column:
    """Population aggregate; 0 for fewer than two rows."""
    return F.when(F.count(value) < 2, F.lit(0.0)).otherwise(F.stddev_pop(value))


def stddev_about(value: Column, centre: Column) -> Column:
    return F.when(F.count(value) < 2, F.lit(0.0)).otherwise(F.sqrt(F.avg((value - centre) * (value - centre))))


def trend_score(current: Column, baseline_mean: Column, baseline_stddev: Column, sigma: float = 2.0) -> Column:
    """Struct zScore, percentChange, isTrending (on the unrounded z)."""
    z = F.when(baseline_stddev > 0, (current - baseline_mean) / baseline_stddev).otherwise(F.when(current > baseline_mean, 10.0).otherwise(0.0))
    change = F.when(baseline_mean > 0, (current - baseline_mean) / baseline_mean * 100).otherwise(F.when(current > 0, 100.0).otherwise(0.0))
    return F.struct(round2(z).alias("zScore"), round0(change).cast("bigint").alias("percentChange"), (z >= sigma).alias("isTrending"))


def baseline(value: Column) -> Column:
    """Aggregate struct mean, stddev of past counts, rounded to two decimals."""
    return F.struct(round2(mean(value)).alias("mean"), round2(stddev(value)).alias("stddev"))


def detect_trends(counts: DataFrame, sigma: float = 2.0, min_baseline: int = 3) -> DataFrame:
    """TrendResult per topic of ``counts`` (topicId, topicName, date, count), highest z first.

    The latest date is current, the others the history; z uses the rounded baseline. One
    shuffle: the latest count comes out of the same aggregate as the moments of all, and
    is taken out of them again, so no topic's rows are sorted.
    """
    x = F.col("count").cast("double")
    latest = F.max(F.struct("date", x.alias("x")))
    agg = counts.groupBy("topicId").agg(
        F.max("topicName").alias("topicName"), latest["x"].alias("current"), F.count("*").alias("n"), F.sum(x).alias("s"), F.avg(x).alias("avg"), F.var_pop(x).alias("var")
    )
    agg = agg.where((F.col("n") >= 2) & (F.col("n") - 1 >= min_baseline))
    m, c = F.col("n") - 1, F.col("current")
    avg = (F.col("s") - c) / m
    # The sum of squares about the mean, less the part of the latest count.
    var = F.greatest(F.lit(0.0), F.col("var") * F.col("n") - (c - F.col("avg")) * (c - avg)) / m
    base = agg.withColumn("baselineMean", round2(avg)).withColumn("baselineStdDev", F.when(m < 2, 0.0).otherwise(round2(F.sqrt(var))))
    scored = base.withColumn("t", trend_score(c, F.col("baselineMean"), F.col("baselineStdDev"), sigma))
    out = scored.select("topicId", "topicName", c.cast("bigint").alias("currentCount"), "baselineMean", "baselineStdDev", "t.zScore", "t.percentChange", "t.isTrending")
    return out.orderBy(F.desc("zScore"), "topicId")


def sliding_baseline(counts: DataFrame, rows: int = 7) -> DataFrame:
    """``counts`` (topicId, date, count) with the baseline of the up to ``rows`` dates before each."""
    past = W.partitionBy("topicId").orderBy("date").rowsBetween(-rows, -1)
    x = F.col("count").cast("double")
    sd = F.when(F.count(x).over(past) < 2, 0.0).otherwise(F.stddev_pop(x).over(past))
    return counts.withColumns({"baselineMean": round2(F.coalesce(F.avg(x).over(past), F.lit(0.0))), "baselineStdDev": round2(sd)})


def filter_trending(trends: DataFrame) -> DataFrame:
    return trends.where("isTrending")


def detect_anomalies(points: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Every point of ``points`` (series, date, value) with its z-score against its series.

    The series' statistics come from an aggregate that joins back, so a long series is
    spread over tasks. Series of one point give no rows.
    """
    stats = points.groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).where("n >= 2")
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("m")) / F.col("sd")).otherwise(F.lit(0.0))
    odd = F.abs(F.col("z")) > sigma
    direction = F.when(~odd, "normal").when(F.col("z") > 0, "above").otherwise("below")
    joined = points.join(stats.withColumnRenamed("series", "s"), F.col("series").eqNullSafe(F.col("s"))).withColumn("z", z)
    return joined.select("series", "date", "value", round2(F.col("z")).alias("zScore"), odd.alias("isAnomaly"), direction.alias("direction"), round2(F.col("m")).alias("mean"), round2(F.col("sd")).alias("stdDev"))


def anomaly_report(points: DataFrame, sigma: float = 2.0) -> DataFrame:
    """One AnomalyReport per series; anomalies in date order, mean 0 and none for one point."""
    found = detect_anomalies(points, sigma)
    item = F.struct("date", "value", "zScore", "isAnomaly", "direction")
    groups = found.groupBy("series").agg(F.array_sort(F.collect_list(item)).alias("anomalies"), F.first("mean").alias("mean"), F.first("stdDev").alias("stdDev"))
    every = points.select("series").distinct()
    every = every.join(groups.withColumnRenamed("series", "s"), F.col("series").eqNullSafe(F.col("s")), "left")
    none = F.array().cast(groups.schema["anomalies"].dataType)
    return every.select("series", F.coalesce("anomalies", none).alias("anomalies"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("stdDev", F.lit(0.0)).alias("stdDev"), F.lit(float(sigma)).alias("threshold"))


def baselines(history: DataFrame) -> DataFrame:
    """(series, n, mean, stdDev) of ``history`` (series, value)."""
    return history.groupBy("series").agg(F.count("*").alias("n"), mean(F.col("value")).alias("mean"), stddev(F.col("value")).alias("stdDev"))


def value_anomalous(values: DataFrame, history: DataFrame, sigma: float = 2.0) -> DataFrame:
    """``values`` (series, value) with isAnomalous against the history; also for a stream of values."""
    b = baselines(history).withColumnRenamed("series", "__series")
    x, m, sd = F.col("value"), F.col("mean"), F.col("stdDev")
    odd = F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, False).when(sd == 0, x != m).otherwise(F.abs((x - m) / sd) > sigma)
    joined = values.join(b, F.col("series").eqNullSafe(F.col("__series")), "left")
    return joined.withColumn("isAnomalous", odd).drop("__series", "n", "mean", "stdDev")
