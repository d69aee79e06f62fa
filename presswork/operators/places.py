"""Hub urls of places, and which places are covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.core.jscompat import round0
from presswork.functions.geo import COUNTRY_PATTERNS, hub_urls, name_variants, to_slug


def predict_hub_urls(places: DataFrame, domain: Column, patterns: tuple[tuple[str, float], ...] = COUNTRY_PATTERNS) -> DataFrame:
    """``places`` (name, code, slug, nameVariants) times their urls: rank, url, weight."""
    variants = name_variants(F.col("name"), F.col("code"), F.col("slug"), F.col("nameVariants"))
    every = places.withColumn("__v", variants).withColumn("__u", hub_urls(domain, F.col("__v"), patterns))
    return every.select(*places.columns, F.posexplode("__u").alias("rank", "__x")).select(*places.columns, (F.col("rank") + 1).alias("rank"), "__x.url", "__x.weight")


def analyze_gaps(known: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with ``covered``: whether a known place has the same slug."""
    slugs = known.select(to_slug(F.col("name")).alias("__known")).distinct()
    joined = places.withColumn("__slug", to_slug(F.col("name"))).join(slugs, F.col("__slug") == F.col("__known"), "left")
    return joined.withColumn("covered", F.col("__known").isNotNull()).drop("__slug", "__known")


def coverage(gaps: DataFrame) -> DataFrame:
    """One row: covered, missing, coveragePercent (0 without places)."""
    yes = F.sum(F.col("covered").cast("bigint"))
    percent = F.when(F.count("*") > 0, round0(yes / F.count("*") * 100)).otherwise(F.lit(0)).cast("bigint")
    return gaps.agg(F.coalesce(yes, F.lit(0)).alias("covered"), (F.count("*") - F.coalesce(yes, F.lit(0))).alias("missing"), percent.alias("coveragePercent"))
