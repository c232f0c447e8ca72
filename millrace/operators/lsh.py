"""Banded indexes over signatures: threshold LSH, forest, ensemble and Bloom, as tables and equi-joins."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.params import RATIOS, band_params, containment_params, size_partitions


@dataclass(frozen=True)
class LshSpec:
    threshold: float = 0.9
    num_perm: int = 128
    weights: tuple[float, float] = (0.5, 0.5)
    params: tuple[int, int] | None = None

    def __post_init__(self):
        if not 0 <= self.threshold <= 1 or self.num_perm < 2:
            raise ValueError("threshold must be 0 to 1 and num_perm 2 or more")
        if any(not 0 <= w <= 1 for w in self.weights) or sum(self.weights) != 1.0:
            raise ValueError("weights must be 0 to 1 and sum to 1")
        if self.b * self.r > self.num_perm or self.b < 2:
            raise ValueError("b must be 2 or more and b * r at most num_perm")

    @property
    def b(self) -> int:
        return (self.params or band_params(self.threshold, self.num_perm, *self.weights))[0]

    @property
    def r(self) -> int:
        return (self.params or band_params(self.threshold, self.num_perm, *self.weights))[1]


def _same_kind(df: DataFrame, n: int, column: str = "sig") -> dict:
    meta = df.schema[column].metadata or {}
    if meta.get("num_perm", n) != n:
        raise ValueError(f"signatures have {meta['num_perm']} values, the index takes {n}")
    return meta


def _index_of(df: DataFrame) -> dict:
    return (df.schema["slice"].metadata or {}).get("index", {}) if "slice" in df.columns else {}


def bands(sigs: DataFrame, spec: LshSpec, key: str = "doc_id", column: str = "sig") -> DataFrame:
    """(key, band, bucket, slice): bucket hashes the slice and is what joins; the slice settles equality.

    column: plain signatures, or weighted ones (arrays of structs). Null signatures are left out.
    """
    meta = _same_kind(sigs, spec.num_perm, column)
    parts = F.transform(F.sequence(F.lit(0), F.lit(spec.b - 1)), lambda i: F.slice(column, i * spec.r + 1, spec.r))
    rows = sigs.where(F.col(column).isNotNull()).select(key, F.posexplode(parts).alias("band", "slice")).withColumn("bucket", F.xxhash64("slice"))
    return rows.withMetadata("slice", {"index": {"b": spec.b, "r": spec.r, **{k: meta[k] for k in ("kind", "seed", "num_perm", "hash") if k in meta}}})


def query(probes: DataFrame, index: DataFrame, key: str = "doc_id", as_: str = "query_id", first_bands: int | None = None) -> DataFrame:
    """(query_id, key): keys that share a bucket in any band, each once; the first bands only where asked for."""
    if first_bands is not None and not 0 < first_bands <= _index_of(index).get("b", first_bands):
        raise ValueError("first_bands must be 1 to the number of bands")
    q = probes.select(F.col(key).alias(as_), F.col("band").alias("qband"), F.col("bucket").alias("qbucket"), F.col("slice").alias("qslice"))
    if first_bands is not None:
        q = q.where(F.col("qband") < first_bands)
    met = q.join(index, (F.col("qband") == F.col("band")) & (F.col("qbucket") == F.col("bucket")) & (F.col("qslice") == F.col("slice")))
    return met.select(as_, key).distinct()


def ranked(found: DataFrame, sigs: DataFrame, n: int, k: int | None = None, key: str = "doc_id", column: str = "sig") -> DataFrame:
    """(query_id, key, estimate, rank) of a query's answers by the similarity that the signatures estimate, ties by key; the first k where asked for."""
    x, y = sigs.select(F.col(key).alias("query_id"), F.col(column).alias("x")), sigs.select(key, F.col(column).alias("y"))
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    rows = found.join(y, key).join(x, "query_id").select("query_id", key, (same / F.lit(float(n))).alias("estimate"))
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("estimate").desc(), key)))
    return out if k is None else out.where(F.col("rank") <= k)


def in_all(found: DataFrame, n_queries: int | Column, key: str = "doc_id", by: list[str] | None = None) -> DataFrame:
    """Keys that every one of the buffered queries has found; with `by`, for each buffer that it names."""
    return found.groupBy(*(by or []), key).agg(F.count("*").alias("__n")).where(F.col("__n") == n_queries).select(*(by or []), key)


def is_empty(index: DataFrame) -> bool:
    """Whether some band has no rows; so is a forest or an ensemble without rows."""
    if "band" not in index.columns:
        return index.isEmpty()
    want = _index_of(index).get("b", 1)
    return index.select("band").distinct().count() < want


def inserted(index: DataFrame, new: DataFrame, key: str = "doc_id", check: bool = True) -> DataFrame:
    """The index with the rows of another one of the same kind. Keys that are there already, or twice among the new ones, are an error, where `check` asks for that."""
    _mergeable(index, new)
    if check:
        first = new.where("band = 0") if "band" in new.columns else new
        if not duplicate_keys(first, key).isEmpty() or not first.select(key).join(index.select(key), key, "left_semi").isEmpty():
            raise ValueError("a key is in the index already")
    return index.unionByName(new)


def removed(index: DataFrame, keys: DataFrame, key: str = "doc_id", check: bool = False) -> DataFrame:
    """The index without these keys; a key that is not in it is an error, where `check` asks for that."""
    gone = keys.select(key).distinct()
    if check and not gone.join(index.select(key), key, "left_anti").isEmpty():
        raise KeyError("a key is not in the index")
    return index.join(gone, key, "left_anti")


def contained(keys: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    there = index.select(F.col(key).alias("__k")).distinct()
    return keys.join(there, F.col(key) == F.col("__k"), "left").select(key, F.col("__k").isNotNull().alias("present"))


def duplicate_keys(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def _mergeable(x: DataFrame, y: DataFrame) -> None:
    mine, other = _index_of(x), _index_of(y)
    if mine and other and mine != other:
        raise ValueError(f"the indexes differ: {mine} and {other}")


def merged(x: DataFrame, y: DataFrame, key: str = "doc_id", check_overlap: bool = False) -> DataFrame:
    """Both indexes in one; they must have the same bands, seed and hash."""
    _mergeable(x, y)
    if check_overlap and not x.select(key).intersect(y.select(key)).isEmpty():
        raise ValueError("the indexes share keys")
    return x.unionByName(y)


def occupancy(index: DataFrame, keys: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(band, bucket, slice, n): how many keys each bucket holds; of these keys only, where they are given."""
    rows = index if keys is None else index.join(keys.select(key).distinct(), key, "left_semi")
    return rows.groupBy("band", "bucket", "slice").agg(F.count("*").alias("n"))


def counts(index: DataFrame, keys: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(band, bucket_size, buckets): how many buckets of each size a band has."""
    return occupancy(index, keys, key).groupBy("band", F.col("n").alias("bucket_size")).agg(F.count("*").alias("buckets"))


def set_jaccard(x: str | Column, y: str | Column) -> Column:
    """Exact Jaccard similarity of two arrays of distinct values; two empty sets have 0."""
    both = F.size(F.array_intersect(x, y))
    whole = F.size(x) + F.size(y) - both
    return F.when(whole == 0, 0.0).otherwise(both / whole)


def containment(queries: DataFrame, sets: DataFrame, least: float, qkey: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(qkey, key, both, m, n): sets (key, tokens) that hold at least the share `least`, above 0, of a query's distinct tokens (qkey, tokens).

    Such a set has one of the query's m - ceil(least * m) + 1 rarest tokens, so only these meet the sets' tokens;
    what then meets is compared whole.
    """
    q = queries.select(qkey, F.size("tokens").alias("m"), F.explode("tokens").alias("t"))
    seen = sets.select(key, F.explode("tokens").alias("u")).join(q.select("t").distinct(), F.col("u") == F.col("t"), "left_semi")
    often = seen.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy(qkey).orderBy(F.coalesce("df", F.lit(0)), "t"))
    rare = q.join(often, F.col("t") == F.col("v"), "left").withColumn("place", rank).where(F.col("place") <= F.col("m") - F.ceil(F.col("m") * least - 1e-9) + 1)
    met = rare.join(seen, F.col("t") == F.col("u")).select(qkey, key).distinct()
    both = F.size(F.array_intersect("x", "y"))
    whole = met.join(queries.select(qkey, F.col("tokens").alias("x")), qkey).join(sets.select(key, F.col("tokens").alias("y")), key)
    return whole.select(qkey, key, both.alias("both"), F.size("x").alias("m"), F.size("y").alias("n")).where(F.col("both") >= F.col("m") * least - 1e-9)


# Forest: top k by the depth to which trees agree


@dataclass(frozen=True)
class ForestSpec:
    num_perm: int = 128
    l: int = 8  # noqa: E741

    def __post_init__(self):
        if self.l <= 0 or self.num_perm <= 0 or self.l > self.num_perm:
            raise ValueError("l must be 1 to num_perm")

    @property
    def k(self) -> int:
        return self.num_perm // self.l


def trees(sigs: DataFrame, spec: ForestSpec, key: str = "doc_id", column: str = "sig") -> DataFrame:
    """(key, tree, hv); column: plain or weighted signatures, null ones are left out."""
    _same_kind(sigs, spec.num_perm, column)
    parts = F.transform(F.sequence(F.lit(0), F.lit(spec.l - 1)), lambda i: F.slice(column, i * spec.k + 1, spec.k))
    return sigs.where(F.col(column).isNotNull()).select(key, F.posexplode(parts).alias("tree", "hv"))


def forest_top(probes: DataFrame, index: DataFrame, k: int, spec: ForestSpec, key: str = "doc_id") -> DataFrame:
    """(query_id, key, depth): the k keys that agree deepest with the query in some tree; ties by key."""
    if k <= 0:
        raise ValueError("k must be positive")
    q = probes.select(F.col(key).alias("query_id"), F.col("tree").alias("qtree"), F.col("hv").alias("qhv"), F.col("hv")[0].alias("q0"))
    met = q.join(index.withColumn("h0", F.col("hv")[0]), (F.col("qtree") == F.col("tree")) & (F.col("q0") == F.col("h0")))
    same = F.zip_with("qhv", "hv", lambda a, b: a == b)
    depth = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.lit(spec.k)).cast("int")
    best = met.groupBy("query_id", key).agg(F.max(depth).alias("depth"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("depth").desc(), key))
    return best.withColumn("rn", rank).where(F.col("rn") <= k).drop("rn")


# Ensemble: containment


@dataclass(frozen=True)
class EnsembleSpec:
    threshold: float = 0.9
    num_perm: int = 128
    num_part: int = 16
    m: int = 8

    def __post_init__(self):
        if self.num_part < 1 or not 2 <= self.m <= self.num_perm or not 0 <= self.threshold <= 1:
            raise ValueError("num_part must be positive, m 2 to num_perm, threshold 0 to 1")

    def choices(self) -> list[tuple[int, int]]:
        return [containment_params(self.threshold, self.num_perm, self.m, float(x)) for x in RATIOS]


def partitions(sized: DataFrame, spec: EnsembleSpec, size: str = "size") -> list[tuple[int, int]]:
    """Size intervals from the histogram of sizes, which is bound by the largest set's size."""
    rows = sorted(tuple(r) for r in sized.where(F.col(size) > 0).groupBy(size).agg(F.count("*").alias("n")).collect())
    return size_partitions([r[0] for r in rows], [r[1] for r in rows], spec.num_part)


def partition_costs(sized: DataFrame, parts: list[tuple[int, int]], size: str = "size", uniform: bool = False) -> DataFrame:
    """(part, expected): the false positives that each interval of sizes brings if its sets are all taken to be as large as its largest; by their real sizes or as if these were spread evenly."""
    n = F.col(size)
    part = F.coalesce(*[F.when(n.between(lo, hi), i) for i, (lo, hi) in enumerate(parts)])
    sums = sized.where(n > 0).select(n.alias("n"), part.alias("part")).groupBy("part").agg(F.max("n").alias("u"), F.min("n").alias("l"), F.sum("n").alias("s"), F.count("*").alias("c"))
    real, even = F.col("c") - F.col("s") / F.col("u"), F.col("c") * (F.col("u") - F.col("l")) / (2 * F.col("u"))
    return sums.select("part", (even if uniform else real).alias("expected"))


def ensemble_index(sigs: DataFrame, parts: list[tuple[int, int]], spec: EnsembleSpec, key: str = "doc_id") -> DataFrame:
    """(key, part, r, band, bucket, slice) of sigs (key, sig, size): one row for each r in use and each band of it."""
    rs = sorted({r for _, r in spec.choices()})
    part = F.coalesce(*[F.when((F.col("size") >= lo) & (F.col("size") <= hi), i) for i, (lo, hi) in enumerate(parts)]) if parts else F.lit(0)

    def of(r: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(spec.num_perm // r - 1)), lambda i: F.struct(F.lit(r).alias("r"), i.alias("band"), F.slice("sig", i * r + 1, r).alias("slice")))

    rows = F.flatten(F.array(*[of(r) for r in rs]))
    return sigs.select(key, part.alias("part"), F.explode(rows).alias("x")).select(key, "part", "x.*").withColumn("bucket", F.xxhash64("slice"))


def ensemble_query(probes: DataFrame, index: DataFrame, parts: list[tuple[int, int]], spec: EnsembleSpec, key: str = "doc_id") -> DataFrame:
    """(query_id, key) for probes (key, sig, size). Each partition is asked with the bands for its upper size over the query's."""
    choices = spec.choices()
    ways = []
    for i, (_, hi) in enumerate(parts):
        ratio = F.lit(float(hi)) / F.col("size")
        at = F.lit(len(RATIOS) - 1)
        for j in reversed(range(len(RATIOS))):
            at = F.when(ratio <= float(RATIOS[j]), j).otherwise(at)
        ways.append(F.struct(F.lit(i).alias("qpart"), at.alias("c")))
    bs, rs = F.array(*[F.lit(b) for b, _ in choices]), F.array(*[F.lit(r) for _, r in choices])
    q = probes.where("size > 0").select(F.col(key).alias("query_id"), "sig", F.explode(F.array(*ways)).alias("w")).select("query_id", "sig", "w.qpart", bs[F.col("w.c")].alias("b"), rs[F.col("w.c")].alias("qr"))
    q = q.select("query_id", "qpart", "qr", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda i: F.slice("sig", i * F.col("qr") + 1, F.col("qr")))).alias("qband", "qslice")).withColumn("qbucket", F.xxhash64("qslice"))
    met = q.join(index, (F.col("qpart") == F.col("part")) & (F.col("qr") == F.col("r")) & (F.col("qband") == F.col("band")) & (F.col("qbucket") == F.col("bucket")) & (F.col("qslice") == F.col("slice")))
    return met.select("query_id", key).distinct()


# Bloom: existence only


@dataclass(frozen=True)
class BloomSpec:
    n: int
    fp: float

    def __post_init__(self):
        if self.n <= 0 or not 0 < self.fp < 1:
            raise ValueError("n must be positive and fp between 0 and 1")

    @property
    def bits(self) -> int:
        return math.ceil(-self.n * math.log(self.fp) / math.log(2) ** 2)

    @property
    def hashes(self) -> int:
        return max(1, round(self.bits / self.n * math.log(2)))


def _bit(total: Column, spec: BloomSpec) -> Column:
    """Positions of a band's value, from 1: by double hashing of the sum of its values mod 2^61 - 1."""
    h1, h2 = F.pmod(F.xxhash64(total), F.lit(spec.bits)), F.pmod(F.xxhash64(F.lit(1), total), F.lit(max(spec.bits - 1, 1))) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(spec.hashes - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(spec.bits)) + 1)


def bloom_positions(index: DataFrame, spec: BloomSpec) -> DataFrame:
    """(all columns of index, positions)."""
    total = F.pmod(F.aggregate("slice", F.lit(0).cast("bigint"), lambda s, v: s + v), F.lit((1 << 61) - 1))
    return index.withColumn("positions", _bit(total, spec))


def bloom_filter(index: DataFrame, spec: BloomSpec) -> DataFrame:
    """(band, block, bits): each band's bit array, in blocks of 4,096 bytes; blocks without a bit are absent."""
    p = bloom_positions(index, spec).select("band", F.explode("positions").alias("p"))
    return p.groupBy("band", F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def bloom_union(*filters: DataFrame) -> DataFrame:
    """The filter of all that any of these filters holds; they must have the same BloomSpec."""
    return reduce(DataFrame.unionByName, filters).groupBy("band", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def bloom_query(probes: DataFrame, filter_: DataFrame, spec: BloomSpec, key: str = "doc_id") -> DataFrame:
    """(key, seen): whether all positions of any band are set. Probes of a block come together in one row before they meet the block."""
    p = bloom_positions(probes, spec).select(key, F.col("band").alias("qband"), F.explode(F.array_distinct("positions")).alias("p"))
    p = p.select(key, "qband", F.bitmap_bucket_number("p").alias("qblock"), F.bitmap_bit_position("p").cast("int").alias("q"))
    hit = p.join(filter_, (F.col("qband") == F.col("band")) & (F.col("qblock") == F.col("block")), "left")
    byte = F.conv(F.hex(F.substr("bits", F.shiftright("q", 3) + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.when(F.col("bits").isNull(), 0).otherwise(F.getbit(byte, F.col("q").bitwiseAND(7)).cast("int"))
    band = hit.select(key, "qband", set_.alias("set")).groupBy(key, "qband").agg(F.min("set").alias("all"))
    return band.groupBy(key).agg((F.max("all") == 1).alias("seen"))


def bloom_checked(found: DataFrame, probes: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seen) of a filter's answers `found`, exactly: what the filter holds to be seen is looked up in the index that it was made of.

    A filter denies nothing that is there, so only its positives are looked up: false ones come of the filter, and of bands with equal sums.
    """
    maybe = probes.join(found.where("seen").select(key), key, "left_semi").select(F.col(key).alias("__k"), F.col("band").alias("qband"), F.col("bucket").alias("qbucket"), F.col("slice").alias("qslice"))
    there = maybe.join(index, (F.col("qband") == F.col("band")) & (F.col("qbucket") == F.col("bucket")) & (F.col("qslice") == F.col("slice")), "left_semi").select("__k").distinct()
    return found.join(there, F.col(key) == F.col("__k"), "left").select(key, F.col("__k").isNotNull().alias("seen"))


def bloom_save(store, name: str, filter_: DataFrame, spec: BloomSpec) -> None:
    """Into a store, with what the filter was made for."""
    store.save(name, filter_.withColumns({"n": F.lit(spec.n).cast("bigint"), "fp": F.lit(spec.fp)}))


def bloom_load(store, name: str) -> tuple[DataFrame, BloomSpec]:
    """The filter and its spec; an empty one is an error."""
    df = store.load(name)
    row = df.select("n", "fp").first()
    if row is None:
        raise ValueError("the filter holds nothing")
    return df.drop("n", "fp"), BloomSpec(row.n, row.fp)
