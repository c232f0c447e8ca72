"""HyperLogLog and HyperLogLog++ as rows (group, idx, rank): a merge is a maximum, with a partial step."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sha1_32, sha1_64


@dataclass(frozen=True)
class HllSpec:
    p: int = 8
    plus: bool = False

    def __post_init__(self):
        if not 4 <= self.p <= 16:
            raise ValueError("p must be 4 to 16")

    @property
    def m(self) -> int:
        return 1 << self.p

    @property
    def alpha(self) -> float:
        return {4: 0.673, 5: 0.697, 6: 0.709}.get(self.p, 0.7213 / (1.0 + 1.079 / self.m))

    @property
    def bytes(self) -> int:
        return 1 + self.m


def placed(h: Column, spec: HllSpec) -> tuple[Column, Column]:
    """Register and rank of a hash: the low p bits, and how far the first one stands in the others."""
    rest = F.shiftrightunsigned(h, spec.p)
    length = F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    return h.bitwiseAND(spec.m - 1).cast("int"), (F.lit((64 if spec.plus else 32) - spec.p + 1) - length).cast("int")


def registers(df: DataFrame, groups: list[str], value: Column, spec: HllSpec, hashed: bool = False) -> DataFrame:
    """(groups, idx, rank); absent registers are zero. Null values are skipped."""
    h = value if hashed else (sha1_64 if spec.plus else sha1_32)(value.cast("string"))
    idx, rank = placed(F.col("__h"), spec)
    return df.where(value.isNotNull()).select(*groups, h.alias("__h")).select(*groups, idx.alias("idx"), rank.alias("rank")).groupBy(*groups, "idx").agg(F.max("rank").alias("rank"))


def union(*parts: DataFrame, groups: list[str] = ()) -> DataFrame:
    if len(parts) < 2:
        raise ValueError("a union takes two sketches or more")
    return reduce(DataFrame.unionByName, parts).groupBy(*groups, "idx").agg(F.max("rank").alias("rank"))


def bias_tables(spark: SparkSession, p: int) -> tuple[float, list[float], list[float]]:
    """Threshold, raw estimates and biases that Spark itself carries for its own HLL++."""
    helper = spark._jvm.org.apache.spark.sql.catalyst.util.HyperLogLogPlusPlusHelper
    return float(helper.THRESHOLDS()[p - 4]), list(helper.RAW_ESTIMATE_DATA()[p - 4]), list(helper.BIAS_DATA()[p - 4])


def estimates(regs: DataFrame, groups: list[str], spec: HllSpec) -> DataFrame:
    """(groups, estimate). Where every register is set, linear counting has nothing to go by and the raw estimate stands."""
    m = float(spec.m)
    sums = regs.groupBy(*groups).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("n"))
    zeros = F.lit(m) - F.col("n")
    raw = F.lit(spec.alpha * m * m) / (F.col("s") + zeros)
    linear = F.lit(m) * F.log(F.lit(m) / zeros)
    rows = sums.withColumn("e", raw).withColumn("z", zeros)
    if not spec.plus:
        two32 = float(1 << 32)
        est = F.when(F.col("e") <= 2.5 * m, F.when(F.col("z") > 0, linear).otherwise(F.col("e"))).when(F.col("e") <= two32 / 30, F.col("e")).otherwise(-two32 * F.log(1 - F.col("e") / two32))
        return rows.select(*groups, est.alias("estimate"))
    threshold, raws, biases = bias_tables(regs.sparkSession, spec.p)
    known = F.array(*[F.struct(F.lit(x).alias("e"), F.lit(b).alias("b"), F.lit(i).alias("i")) for i, (x, b) in enumerate(zip(raws, biases))])
    # the six nearest known estimates; the table has some 200 rows and is part of the expression
    near = F.slice(F.array_sort(F.transform(known, lambda k: F.struct(F.pow(k["e"] - F.col("e"), 2).alias("d"), k["i"].alias("i"), k["b"].alias("b")))), 1, 6)
    bias = F.aggregate(near, F.lit(0.0), lambda s, k: s + k["b"]) / 6.0
    counted = F.when(F.col("z") > 0, linear)
    est = F.when(counted <= threshold, counted).when(F.col("e") <= 5 * m, F.col("e") - bias).otherwise(F.col("e"))
    return rows.select(*groups, est.alias("estimate"))


def undense(sketches: DataFrame, groups: list[str], spec: HllSpec, sketch: str = "sketch") -> DataFrame:
    """(groups, idx, rank) of serialised sketches; registers of rank zero are absent. A sketch of another p or length is an error when it is read."""
    h = F.hex(sketch)
    good = (F.length(sketch) == spec.bytes) & (F.substring(h, 1, 2) == F.lit(f"{spec.p:02X}"))
    checked = F.when(F.coalesce(good, F.lit(False)), h).otherwise(F.raise_error(F.lit(f"not a sketch of p = {spec.p}")).cast("string"))
    ranks = F.transform(F.sequence(F.lit(1), F.lit(spec.m)), lambda i: F.conv(F.substr("__h", i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    rows = sketches.select(*groups, checked.alias("__h")).select(*groups, F.posexplode(ranks).alias("idx", "rank"))
    return rows.where("rank > 0")


def equal(x: DataFrame, y: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, equal): whether two tables of registers hold the same ones for a group; groups of either."""
    both = x.select(*groups, "idx", F.col("rank").alias("__x")).join(y.select(*groups, "idx", F.col("rank").alias("__y")), [*groups, "idx"], "full")
    return both.groupBy(*groups).agg(F.bool_and(F.col("__x").eqNullSafe(F.col("__y"))).alias("equal"))


def dense(regs: DataFrame, groups: list[str], spec: HllSpec) -> DataFrame:
    """(groups, sketch): the serialised form, p and then a byte for each register."""
    ranks = F.map_from_entries(F.collect_list(F.struct("idx", "rank")))
    byte = F.transform(F.sequence(F.lit(0), F.lit(spec.m - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.element_at("r", i), F.lit(0))), 2, "0"))
    return regs.groupBy(*groups).agg(ranks.alias("r")).select(*groups, F.unhex(F.concat(F.lit(f"{spec.p:02X}"), F.concat_ws("", byte))).alias("sketch"))


def jaccard(a: Column, b: Column, both: Column) -> Column:
    """By inclusion and exclusion; two empty sets are alike."""
    return F.when(both == 0, 1.0).otherwise((a + b - both) / both)


def inclusion(a: Column, b: Column, both: Column) -> Column:
    return F.when(a == 0, 1.0).otherwise((a + b - both) / a)


def minhash_inclusion(j: Column, a: Column, b: Column) -> Column:
    return (j / (j + 1.0)) * (1.0 + b / a)
