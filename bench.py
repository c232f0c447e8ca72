"""Times the headline queries; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from millrace.plans import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["minhash_signature", "minhash_count", "minhash_union_by_source", "lsh_query", "lsh_counts", "forest_topk", "exact_containment_threshold", "hll_count", "hllpp_count", "hll_union", "bloom_query", "knn_exact_l2", "weighted_minhash_jaccard", "recall_at_k"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(64).repartition(int(CPUS)).mapInArrow(lambda batches: batches, "id bigint").count()  # starts the Python workers
    took = {}
    t = time.perf_counter()
    registry.signed(spark, SF).count()  # the signatures that the queries after it read
    took["index_build"] = round(time.perf_counter() - t, 3)
    for name in NAMES:
        t = time.perf_counter()
        registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
