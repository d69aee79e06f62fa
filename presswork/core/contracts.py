"""Schemas of the data the operators take and give, and row validation against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Each contract as a DDL string; optional fields are nullable columns.
CONTRACTS: dict[str, str] = {
    "DateRange": "startDate timestamp, endDate timestamp",
    "ArticleInput": "id string, content string, headline string, simHash string, publishedAt timestamp, sourceDomain string",
    "Cluster": "id string, memberIds array<string>, centerSimHash string, createdAt timestamp",
    "ArticleGroup": "id string, centerArticleId string, memberIds array<string>, averageDistance double",
    "SentimentResult": "score double, normalizedScore double, confidence double, label string, wordCount bigint, sentimentWords bigint",
    "TopicCount": "topicId string, topicName string, date string, count bigint",
    "TrendResult": "topicId string, topicName string, currentCount bigint, baselineMean double, baselineStdDev double, zScore double, percentChange bigint, isTrending boolean",
    "TimeSeriesPoint": "date timestamp, value double",
    "Anomaly": "date string, value double, zScore double, isAnomaly boolean, direction string",
    "AnomalyReport": "anomalies array<struct<date:string,value:double,zScore:double,isAnomaly:boolean,direction:string>>, mean double, stdDev double, threshold double",
    "PathStep": "nodeId string, condition string, result boolean, branch string",
    "EvaluationResult": "match boolean, confidence double, path array<struct<nodeId:string,condition:string,result:boolean,branch:string>>, reason string",
    "EvaluationContext": "url string, title string, content string, wordCount bigint, flags map<string,boolean>",
    "CategoryResult": "category string, confidence double, matchedPattern string",
    "ExtractionInput": "title string, content string, author string, publishDate string, section string, wordCount bigint",
    "ConfidenceResult": "score double, level string, factors struct<title:double,length:double,metadata:double>, recommendation string",
    "PlaceMetadata": "name string, code string, slug string, nameVariants array<string>, region string, importance double",
    "UrlPattern": "pattern string, weight double, isPrefix boolean",
    "UrlSignals": "url string, visits bigint, lastVisited timestamp, lastChanged timestamp, topicRelevance double, hubDepth int, isHub boolean",
    "ScoredUrl": "url string, score double, reasons array<string>",
    "RankedSentence": "index int, text string, score double",
    "Keyword": "word string, score double",
    "DocumentFrequency": "term string, df bigint",
}
#: Rules beyond types, as SQL conditions, and the defaults of optional fields.
RULES: dict[str, dict[str, str]] = {
    "ArticleInput": {"id": "id is not null", "headline": "headline is not null", "simHash": "simHash rlike '^[a-fA-F0-9]{16}$'", "publishedAt": "publishedAt is not null", "sourceDomain": "sourceDomain is not null"},
    "TopicCount": {"topicId": "topicId is not null", "date": "date is not null", "count": "count is not null"},
    "TimeSeriesPoint": {"date": "date is not null", "value": "value is not null"},
    "PlaceMetadata": {"name": "name is not null"},
    "UrlPattern": {"pattern": "pattern is not null"},
    "UrlSignals": {"url": "url rlike '^[A-Za-z][A-Za-z0-9+.-]*:.+'", "visits": "visits >= 0", "lastVisited": "lastVisited is not null", "topicRelevance": "topicRelevance between 0 and 1", "hubDepth": "hubDepth >= 0"},
}
DEFAULTS: dict[str, dict[str, object]] = {
    "UrlSignals": {"topicRelevance": 0.5, "hubDepth": 0, "isHub": False},
    "UrlPattern": {"weight": 1.0, "isPrefix": False},
}


def with_defaults(df: DataFrame, contract: str) -> DataFrame:
    """Fill the optional fields that have a default."""
    got = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.get(contract, {}).items()}
    return df.withColumns(got) if got else df


def validate(df: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the contract, the others with the names of the failing fields)."""
    df = with_defaults(df, contract)
    failing: list[Column] = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(field)) for field, rule in RULES.get(contract, {}).items()]
    reason = F.concat_ws(",", *failing) if failing else F.lit("")
    marked = df.withColumn("reason", reason)
    return marked.where("reason = ''").drop("reason"), marked.where("reason <> ''")
