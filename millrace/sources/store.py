"""Index stores: in memory, as Parquet, as a table; and the text format of set collections."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def setting(value, default=None):
    """A value, or {"env": NAME, "default": x}: the environment variable's."""
    if isinstance(value, dict) and "env" in value:
        return os.environ.get(value["env"], value.get("default", default))
    return default if value is None else value


class IndexStore:
    """Named index tables. type: memory (cached), parquet (path) or table (database). The same basename is the same data."""

    def __init__(self, spark: SparkSession, config: dict):
        self.spark, self.kind = spark, config.get("type")
        if self.kind not in ("memory", "parquet", "table"):
            raise ValueError(f"unknown store type {self.kind}")
        self.base = setting(config.get("basename"), "index")
        self.path = setting(config.get("path"), "")
        self.held: dict[str, DataFrame] = {}

    def save(self, name: str, df: DataFrame, buckets: int = 0, by: tuple[str, ...] = ("band", "bucket")) -> None:
        """Write an index; as a table it can be bucketed by what queries join on, so that they need not move it."""
        if self.kind == "memory":
            self.held[name] = df.cache()
        elif self.kind == "parquet":
            df.write.mode("overwrite").parquet(f"{self.path}/{self.base}/{name}")
        else:
            w = df.write.mode("overwrite")
            (w.bucketBy(buckets, *by).sortBy(*by) if buckets else w).saveAsTable(f"{self.base}_{name}")

    def append(self, name: str, df: DataFrame) -> None:
        if self.kind == "memory":
            self.held[name] = self.held[name].unionByName(df).cache() if name in self.held else df.cache()
        elif self.kind == "parquet":
            df.write.mode("append").parquet(f"{self.path}/{self.base}/{name}")
        else:
            df.write.mode("append").saveAsTable(f"{self.base}_{name}")

    def put(self, name: str, df: DataFrame, epoch: int) -> None:
        """The rows of one batch of a stream: they take the place of what an earlier try of the same batch has left."""
        rows = df.withColumn("epoch", F.lit(epoch).cast("bigint"))
        if self.kind == "memory":
            old = self.held[name].where(F.col("epoch") != epoch).unionByName(rows) if name in self.held else rows
            self.held[name] = old.cache()
            self.held[name].count()
        elif self.kind == "parquet":
            df.write.mode("overwrite").parquet(f"{self.path}/{self.base}/{name}/epoch={epoch}")
        else:
            conf = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            try:
                rows.write.mode("overwrite").partitionBy("epoch").format("parquet").saveAsTable(f"{self.base}_{name}") if not self.spark.catalog.tableExists(f"{self.base}_{name}") else rows.select(*self.spark.table(f"{self.base}_{name}").columns).write.insertInto(f"{self.base}_{name}", overwrite=True)
            finally:
                self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", conf)

    def before(self, name: str, epoch: int) -> DataFrame | None:
        """What batches before this one have put, without the epoch; None if there are none."""
        try:
            df = self.load(name)
        except KeyError:
            return None
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return df.where(F.col("epoch") < epoch).drop("epoch")

    def load(self, name: str) -> DataFrame:
        if self.kind == "memory":
            return self.held[name]
        return self.spark.read.parquet(f"{self.path}/{self.base}/{name}") if self.kind == "parquet" else self.spark.table(f"{self.base}_{name}")


def read_sets(spark: SparkSession, path: str, skip: int = 1, sample: float | None = None, seed: int = 1) -> DataFrame:
    """(key, file, block, place, size, tokens) of text files, gzip or not, with lines `size<TAB>id,id,...`.

    A file is read in blocks, as Spark splits it; place is the line's number in its block, and key a hash of
    file, block and place. The first `skip` lines of each file are its header. A line without a tab is an error.
    """

    def lines(batches):
        import pyarrow as pa
        from pyarrow import compute as pc

        now, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = 0
            while at < len(file):  # the lines of one block follow one another
                end = at
                while end < len(file) and (file[end], block[end]) == (file[at], block[at]):
                    end += 1
                if now != (file[at], block[at]):
                    now, seen = (file[at], block[at]), 0
                head = min(max(skip - seen, 0), end - at) if block[at] == 0 else 0
                n = end - at - head
                if n:
                    two = pc.split_pattern(batch.column(0).slice(at + head, n), "\t", max_splits=1)
                    if pc.any(pc.not_equal(pc.list_value_length(two), 2)).as_py():
                        raise ValueError(f"{file[at]}: a line has no tab")
                    size, ids = pc.list_element(two, 0).cast(pa.int32()), pc.split_pattern(pc.list_element(two, 1), ",")
                    yield pa.RecordBatch.from_arrays([pa.array([file[at]] * n), pa.array([block[at]] * n, pa.int64()), pa.array(range(seen + head, seen + head + n), pa.int64()), size, ids], ["file", "block", "place", "size", "tokens"])
                seen, at = seen + end - at, end

    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    out = rows.mapInArrow(lines, "file string, block bigint, place bigint, size int, tokens array<string>")
    out = out.select(F.xxhash64("file", "block", "place").alias("key"), "file", "block", "place", "size", "tokens")
    return out.sample(sample, seed=seed) if sample is not None else out


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    {"parquet": df.write.mode("overwrite").parquet, "csv": df.write.mode("overwrite").option("header", True).csv, "json": df.write.mode("overwrite").json}[kind](path)
