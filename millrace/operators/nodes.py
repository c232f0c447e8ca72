"""The mapping that a proximity graph is built from: a log of writes (key, vector, seq, deleted).

A later write of a key replaces an earlier one, a write with `deleted` hides it. The order of the
mapping is that of each key's first write. A key is a group of the aggregate, which has a partial step,
so a key with very many versions is not gathered in one task. Null keys are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(points: DataFrame, seq: str | int = 0, deleted: bool = False) -> DataFrame:
    """Log rows of points (key, vector); seq is a column's name or one number for all."""
    at = F.col(seq) if isinstance(seq, str) else F.lit(seq)
    return points.select("key", "vector", at.cast("bigint").alias("seq"), F.lit(deleted).alias("deleted"))


def tombstones(keys: DataFrame, kind: str, seq: str | int) -> DataFrame:
    """Log rows that hide the keys; kind is the vectors' type."""
    return written(keys.withColumn("vector", F.lit(None).cast(kind)), seq, True)


def items(log: DataFrame) -> DataFrame:
    """(key, vector, place): what the mapping holds, tombstones hidden; place orders it by first write. Of writes with one seq a tombstone counts last."""
    last = F.max_by(F.struct("vector", "deleted"), F.struct("seq", "deleted"))
    state = log.where("key IS NOT NULL").groupBy("key").agg(last.alias("s"), F.min("seq").alias("place"))
    return state.where("NOT s.deleted").select("key", "s.vector", "place")


def merged(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """The log of both, theirs after mine: of a key in both, theirs stands. theirs' hidden keys hide nothing of mine."""
    own = items(mine).select("key", "vector", F.struct(F.lit(0).alias("side"), "place").alias("at"))
    both = own.unionByName(items(theirs).select("key", "vector", F.struct(F.lit(1).alias("side"), "place").alias("at")))
    return both.groupBy("key").agg(F.max_by("vector", "at").alias("vector"), F.min("at").alias("at")).select("key", "vector", "at.side", "at.place")


def popped(log: DataFrame, last: bool = True) -> DataFrame:
    """(key, vector) of the item that was written last, or first; ties by key. An empty mapping gives no row."""
    order = [F.col(c).desc() if last else F.col(c) for c in ("place", "key")]
    return items(log).orderBy(*order).limit(1).select("key", "vector")
