"""Crawl priority of urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.core.jscompat import round0


def _hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(3.6e9)


def url_priority(last_visited: Column, last_changed: Column, relevance: Column, depth: Column, is_hub: Column, now: Column | None = None) -> Column:
    """Struct score (bigint, 0 to 100) and reasons; ``now`` defaults to the query's time."""
    now = F.current_timestamp() if now is None else now
    seen, changed = _hours(now, last_visited), F.coalesce(_hours(now, last_changed) < 24, F.lit(False))
    relevance, depth, is_hub = F.coalesce(relevance, F.lit(0.5)), F.coalesce(depth, F.lit(0)), F.coalesce(is_hub, F.lit(False))
    visit = F.when(seen < 1, -30).when(seen < 24, -10).when(seen > 168, 15).otherwise(0)
    score = F.lit(50) + visit + F.when(changed, 20).otherwise(0) + round0(relevance * 15) + F.when(is_hub, 10).otherwise(0) + F.when(depth > 3, -5).otherwise(0)
    reasons = F.array(
        F.when(seen < 1, "Recently visited (<1h)").when(seen < 24, "Visited today").when(seen > 168, "Not visited in 7+ days"),
        F.when(changed, "Changed in last 24h"), F.when(relevance > 0.8, "High topic relevance"), F.when(is_hub, "Is a hub page"), F.when(depth > 3, "Deep URL"),
    )
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint").alias("score"), F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def rank_urls(urls: DataFrame, now: Column | None = None) -> DataFrame:
    """``urls`` (UrlSignals) with score and reasons, highest score first, ties by url."""
    p = url_priority(F.col("lastVisited"), F.col("lastChanged"), F.col("topicRelevance"), F.col("hubDepth"), F.col("isHub"), now)
    scored = urls.withColumn("__p", p)
    return scored.select(*urls.columns, "__p.score", "__p.reasons").orderBy(F.desc("score"), "url")
