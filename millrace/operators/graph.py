"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import dropped, kept


def _stars(pairs: DataFrame, small: bool) -> DataFrame:
    """One round: pairs (v, u) with u < v. Each node's neighbours are tied to the least of them.

    The least neighbour is an aggregate with a partial step, and the join that follows is one that
    adaptive execution splits, so a node with very many links is not gathered in one task.
    """
    if small:
        around = pairs
    else:
        around = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = around.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("m"))
    met = around.join(least, F.col("v") == F.col("node"))
    if small:  # the lesser neighbours, and the node itself, hang on the least
        out = met.select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select(F.col("node").alias("v"), F.col("m").alias("u")))
    else:  # the greater neighbours hang on the least of the node and its neighbours
        out = met.where("u > v").select(F.col("u").alias("v"), F.least("m", "v").alias("u"))
    return out.where("u < v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of links (a, b) reaches; roots themselves are absent."""
    pairs = kept(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "links")
    seen = None
    while True:
        large = _stars(pairs, small=False)
        next_ = kept(_stars(large, small=True), "stars")
        dropped(pairs)
        pairs = next_
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or now[0] == 0:
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = tuple(now)
