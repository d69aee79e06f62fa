"""The Python kernels as SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from presswork.operators.fingerprints import fingerprint
from presswork.operators.summaries import TextRankOptions, rank


def register_sql(spark: SparkSession) -> list[str]:
    """Register ``simhash_of(tokens)`` and ``textrank_scores(sentence tokens)`` with the session.

    Arrays come from the column functions or from SQL itself, such as ``split(text, ' ')``.
    A null array counts as empty. Returns the names.
    """

    def simhash_of(tokens: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(list(x) if x is not None else []):016x}" for x in tokens])

    def textrank_scores(sentences: pd.Series) -> pd.Series:
        options = TextRankOptions()
        return pd.Series([rank([list(t) for t in x], options) if x is not None and len(x) else [] for x in sentences])

    spark.udf.register("simhash_of", F.pandas_udf(simhash_of, "string"))
    spark.udf.register("textrank_scores", F.pandas_udf(textrank_scores, "array<double>"))
    return ["simhash_of", "textrank_scores"]
