"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of the corpus by its weight, at most ``max_repeat`` times its
own size; what a capped source leaves is shared out again by weight. A share of so many
whole sizes is taken as complete epochs; for the rest every document has an exponential
key, -ln(u) divided by its quality weight, and the documents with the smallest keys are
taken until their prefix sum reaches the budget.

Keys are cut into buckets. Sizes are first summed per (source, bucket), so the prefix
sum over documents is needed only in the one bucket per source in which the budget ends;
a source that holds most rows is not sorted as a whole.

Defined cases: a null text has size 0 and a document of size 0 is never taken; a null
source is a source of its own, after all others; ties of a key go by id (nulls first),
then size; repeated rows share a key and are taken next to each other; an empty table
gives an empty result; computed columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.llm.common import materialise, unit, words

BUCKETS = 4096
#: Per-source rows that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def default_weight(size: Column) -> Column:
    """Quality weight that rises with the number of words up to 200."""
    return F.least(F.lit(1.0), (size.cast("double") + 1) / 200)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: int = 3) -> DataFrame:
    """(source, source_size) to targets: water is filled by weight up to the caps.

    ``weights`` repeat over the sources in code point order. Sorted by cap per weight the
    capped sources come first, so one pass of prefix sums finds the level.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(0.0)
    for k, v in enumerate(weights):
        w = F.when((F.col("__n") - 1) % len(weights) == k, F.lit(float(v))).otherwise(w)
    s = sizes.withColumn("__n", F.row_number().over(order)).withColumns({"__w": w, "__cap": (F.lit(max_repeat) * F.col("source_size")).cast("double")})
    by = W.orderBy(F.col("__cap") / F.col("__w"), "__n")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.col("__cap") / F.col("__w"), "__n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    s = s.withColumn("__level", (total - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after))
    s = s.withColumn("__open", F.when(F.col("__cap") >= F.col("__level") * F.col("__w"), F.col("__level")))
    level = F.first("__open", ignorenulls=True).over(everything)
    target = F.least(F.col("__cap"), F.coalesce(level, F.lit(0.0)) * F.col("__w"))
    return s.select("source", "source_size", target.alias("target"))


def mixed(
    docs: DataFrame, text: str = "text", keep_text: bool = True, weight: Column | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: int = 3, salt: str = "mix"
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words, repeats counted)."""
    size = F.size(words(F.col(text))).cast("bigint")
    d = docs.withColumn("size", size)
    if not keep_text:
        d = d.drop(text)
    key = -F.log(unit(F.col("doc_id"), salt)) / (default_weight(F.col("size")) if weight is None else weight)
    d = d.withColumn("__key", key).withColumn("__bucket", F.floor(F.col("__key") / (1 + F.col("__key")) * BUCKETS).cast("int"))
    d = materialise(d, "mix")
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    targets = targets.withColumn("__epochs", epochs).withColumn("__rest", F.col("target") - (F.col("__epochs") * F.col("source_size")).cast("double"))
    targets = materialise(targets, "mix-targets")
    small = targets.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda x: x
    sums = d.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    sums = sums.withColumn("__before", F.sum("__sum").over(W.partitionBy("source").orderBy("__bucket")) - F.col("__sum"))
    t = targets.select(F.col("source").alias("__s"), "__rest")
    ends = sums.join(hint(t), F.col("source").eqNullSafe(F.col("__s"))).where(F.col("__before") + F.col("__sum") > F.col("__rest"))
    ends = ends.groupBy("__s").agg(F.min(F.struct("__bucket", "__before")).alias("__end"))
    ends = targets.withColumnRenamed("source", "__s").join(ends.withColumnRenamed("__s", "__s2"), F.col("__s").eqNullSafe(F.col("__s2")), "left").drop("__s2")
    ends = materialise(ends, "mix-ends")
    d = d.drop(*[c for c in ("source_size", "target", "copies", "taken") if c in docs.columns])
    d = d.join(hint(ends), F.col("source").eqNullSafe(F.col("__s")))
    last = F.col("__bucket") == F.col("__end.__bucket")
    run = W.partitionBy("source").orderBy("__key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    inside = d.where(last).withColumn("__sum", F.col("__end.__before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    picked = (F.col("__sum") + F.col("size") / 2) <= F.col("__rest")
    inside = inside.withColumn("__extra", F.when(picked, 1).otherwise(0)).drop("__sum")
    whole = F.when(F.col("__end").isNull() | (F.col("__bucket") < F.col("__end.__bucket")), F.when(F.col("__rest") > 0, 1).otherwise(0)).otherwise(0)
    rest = d.where(~F.coalesce(last, F.lit(False))).withColumn("__extra", whole)
    out = rest.unionByName(inside)
    copies = F.when(F.col("size") > 0, F.col("__epochs") + F.col("__extra")).otherwise(F.lit(0)).cast("bigint")
    out = out.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("bigint"))
    return out.drop("__key", "__bucket", "__s", "__epochs", "__rest", "__end", "__extra")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it."""
    m = mixed(docs, **options)
    return m.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
