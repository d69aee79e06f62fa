"""Term statistics of documents: frequencies, top words, TF-IDF keywords, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.core.numbering import numbered
from presswork.core.storage import bounded_batches, materialise, release
from presswork.functions.text import stem, stem_column, tokenize
from presswork.operators import matrices

#: Documents and queries of a block.
DOCUMENTS, QUERIES = 4096, 1024


def occurrences(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """(key, term, n, first): how often and where first each term stands in a document."""
    return _counted(_placed(docs, tokens, key), key)


def _placed(docs: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(key, pos, term) of every token, dealt by key.

    Texts are shuffled, and not the far larger rows of their tokens: what follows by key,
    or by key and term, needs no further shuffle.
    """
    return docs.repartition(key).select(key, F.posexplode(tokens).alias("pos", "term"))


def _counted(placed: DataFrame, key: str) -> DataFrame:
    return placed.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def stem_occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """:func:`occurrences` of :func:`stems`; the steps are columns of rows, which stay in generated code."""
    return _counted(stem_column(_placed(docs, tokenize(F.col(text), 3, remove_stopwords=True), key), "term"), key)


def word_frequency(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(key, word, count) of every document."""
    return occurrences(docs, tokenize(F.col(text), **options), key).select(key, F.col("term").alias("word"), F.col("n").alias("count"))


def top_words(docs: DataFrame, n: int = 10, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(key, rank, word, count): the commonest words, ties by first occurrence."""
    found = occurrences(docs, tokenize(F.col(text), **options), key)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", F.col("term").alias("word"), F.col("n").alias("count"))


def term_frequency(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Augmented frequency .5 + .5 * n / max, added to the rows of :func:`occurrences`."""
    top = F.max("n").over(W.partitionBy(key))
    return found.withColumn("tf", F.lit(0.5) + F.lit(0.5) * F.col("n") / top)


def idf(total: Column, df: Column) -> Column:
    return F.log((total.cast("double") + 1) / (F.coalesce(df, F.lit(0)).cast("double") + 1)) + 1


def stems(text: Column) -> Column:
    """What keywords are made of: no stop words, three characters at least, stemmed."""
    return F.transform(tokenize(text, 3, remove_stopwords=True), stem)


def document_frequency(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, df): in how many documents each stem occurs."""
    each = docs.select(F.explode(F.array_distinct(stems(F.col(text)))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def keywords(docs: DataFrame, df: DataFrame | None = None, total: int | None = None, n: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, rank, word, score): the n stems with the highest TF-IDF, ties by first occurrence.

    Texts are read once: their stems are counted into a written table, which also gives
    the document frequencies where no ``df`` (term, df) is handed in. ``df`` may be as
    large as the vocabulary, so its join is left to the planner.
    """
    found = materialise(term_frequency(stem_occurrences(docs, text, key), key), "stems")
    df = found.groupBy("term").agg(F.count("*").alias("df")) if df is None else df
    total = docs.count() if total is None else total
    scored = found.join(df, "term", "left")
    scored = scored.withColumn("score", F.col("tf") * idf(F.lit(total), F.col("df")))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "first"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "rank", F.col("term").alias("word"), "score")


def vocabulary(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """(term, index): terms numbered by first occurrence over documents in key order."""
    each = docs.select(key, F.posexplode(tokens).alias("first", "term"))
    first = each.groupBy("term").agg(F.min(F.struct(key, "first")).alias("at"))
    return numbered(first, "at", "index", "vocabulary").select("term", "index")


def similar_documents(docs: DataFrame, queries: DataFrame, n: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, rank, key, score): nearest documents by cosine of their term counts.

    Stop words do not count, a document never matches itself or one it shares no term
    with; keys are whole numbers, and rows without one take no part. Documents and queries
    are packed into blocks, and every pair of blocks is one product of two sparse matrices
    in a kernel that keeps the n best of each query. So nothing as large as the pairs of
    documents is shuffled or written, only n rows for each query and block of documents.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    bounded_batches(spark)
    counts = occurrences(docs.where(F.col(key).isNotNull()), tokenize(F.col(text), 2, True), key)
    each = counts.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.collect_list("term").alias("t"), F.collect_list("n").alias("n"))
    each = materialise(each, "vectors")
    own = queries.select(F.col(key).cast("bigint").alias("id")).distinct()
    asked = each.join(own, "id", "left_semi").repartition(own.count() // QUERIES + 1)
    blocks = materialise(each.mapInArrow(matrices.packed(DOCUMENTS), matrices.PACK), "blocks")
    packs = materialise(asked.mapInArrow(matrices.packed(QUERIES), matrices.PACK), "packs")
    release(each)
    met = blocks.crossJoin(packs.select(*(F.col(c).alias(f"q_{c}") for c in packs.columns)))
    found = met.mapInArrow(matrices.nearest(n), "query_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(key), "score")
