"""Measures of search results against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of x of a strip of the Pareto frontier, about.
STRIP = 1_000_000


def recall_at_k(found: DataFrame, truth: DataFrame, query: str = "query_id", key: str = "key") -> DataFrame:
    """(query, recall): share of the true answers that were found."""
    hit = truth.select(query, key).join(found.select(query, key).withColumn("hit", F.lit(1)), [query, key], "left")
    return hit.groupBy(query).agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def precision_recall(found: DataFrame, truth: DataFrame, query: str = "query_id", key: str = "key") -> DataFrame:
    """(query, precision, recall, f1) for each query of either table. Nothing found has precision 1 if nothing is true, else 0; nothing true has recall 1."""
    both = found.select(query, key).withColumn("f", F.lit(1)).join(truth.select(query, key).withColumn("t", F.lit(1)), [query, key], "full")
    n = both.groupBy(query).agg(F.count("f").alias("nf"), F.count("t").alias("nt"), F.count(F.col("f") + F.col("t")).alias("n"))
    p = F.when(F.col("nf") > 0, F.col("n") / F.col("nf")).otherwise(F.when(F.col("nt") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("nt") > 0, F.col("n") / F.col("nt")).otherwise(1.0)
    return n.select(query, p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def pareto(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points with a y above that of every point with a larger x; of equal x only the highest can be one. x is a number; points without x or y are none.

    x is cut into strips of about STRIP values. A running maximum goes within each strip, and beside it
    the maximum of all strips further up, of which there is one row a strip.
    """
    best = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias(y))
    strips = -(-best.count() // STRIP)
    cuts = sorted(set(best.approxQuantile(x, [i / strips for i in range(1, strips)], 1 / (4 * strips)))) if strips > 1 else []
    strip = F.array_position(F.transform(F.array(*[F.lit(c) for c in cuts], F.lit(float("inf"))), lambda c: F.col(x) <= c), True)
    rows = best.withColumn("__strip", strip)
    further = F.max("m").over(W.orderBy(F.col("s").desc()).rowsBetween(W.unboundedPreceding, -1))
    tops = rows.groupBy(F.col("__strip").alias("s")).agg(F.max(y).alias("m")).select("s", further.alias("further"))
    above = F.max(y).over(W.partitionBy("__strip").orderBy(F.col(x).desc()).rowsBetween(W.unboundedPreceding, -1))
    met = rows.withColumn("above", above).join(tops, F.col("__strip") == F.col("s"))
    over = F.greatest("above", "further")
    return met.where(over.isNull() | (F.col(y) > over)).select(x, y)


def agreement(a: DataFrame, b: DataFrame, key: str, flag: str) -> DataFrame:
    """Share of keys on which two tables of flags agree."""
    other = b.select(F.col(key), F.col(flag).alias("__o"))
    return a.join(other, key).agg(F.avg((F.col(flag) == F.col("__o")).cast("double")).alias("agreement"))
