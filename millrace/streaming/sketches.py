"""Sketches and indexes over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hll import HllSpec, placed
from ..functions.hashing import sha1_32
from ..operators.lsh import LshSpec, bands, query
from ..operators.minhash import MinHashSpec, signatures, token_sets


def windowed_registers(events: DataFrame, time: str, value: Column, spec: HllSpec, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window, idx, rank) by tumbling windows of event time, with a watermark. Ranks are maxima, so a replayed batch changes nothing."""
    idx, rank = placed(F.col("__h"), spec)
    rows = events.withWatermark(time, late).select(F.col(time).alias("__t"), sha1_32(value.cast("string")).alias("__h"))
    return rows.select(F.window("__t", length).alias("window"), idx.alias("idx"), rank.alias("rank")).groupBy("window", "idx").agg(F.max("rank").alias("rank"))


def near_duplicate_sink(store, spec: LshSpec, sketch: MinHashSpec, name: str = "bands", out: str = "unique", key: str = "doc_id"):
    """A foreachBatch function: documents that share no bucket with those of earlier batches, and in their own batch with none of a lesser key, go into the
    store's tables `out` (their keys) and `name` (their bands).

    Both are written by epoch and looked up by earlier epochs only, so a batch that is tried again, after a
    loss between the two writes too, leaves what it would have left at once. A key that an earlier batch had is known
    by its bands. Of repeated keys within a batch the first text in order counts.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        fresh = batch.groupBy(key).agg(F.min("text").alias("text"))
        index = bands(signatures(token_sets(fresh, key), sketch, key), spec, key).persist()
        try:
            seen = store.before(name, epoch)
            new = index
            if seen is not None:
                hit = query(index, seen, key).select(F.col("query_id").alias(key)).distinct()
                new = index.join(hit, key, "left_anti")
            again = query(new, new, key).where(F.col(key) < F.col("query_id")).select(F.col("query_id").alias(key)).distinct()
            new = new.join(again, key, "left_anti")
            store.put(out, new.select(key).distinct(), epoch)
            store.put(name, new, epoch)
        finally:
            index.unpersist()

    return take


def deletion_sink(store, name: str = "bands", key: str = "doc_id"):
    """A foreachBatch function: the keys of a batch go into the store's table `name`_gone; live() leaves them out."""

    def take(batch: DataFrame, epoch: int) -> None:
        store.put(f"{name}_gone", batch.select(key).distinct(), epoch)

    return take


def live(store, name: str = "bands", key: str = "doc_id") -> DataFrame:
    """The rows of an index in a store whose key no deletion has named."""
    last = 1 << 62
    gone, rows = store.before(f"{name}_gone", last), store.before(name, last)
    return rows if gone is None else rows.join(gone.select(key).distinct(), key, "left_anti")
