"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query writes its full result to the no-op sink: once to compile and warm the page cache, then three times, of which the fastest counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quern import queries as engine

HEADLINE = (
    "flagship", "s1_scan", "s6_multi_get", "p1_project", "p11_exists", "j3_full_join", "j8_many_tables", "j11_prejoin", "j14_timed_prejoin", "a1_group", "a5_distinct",
    "a13_native_group", "o8_top_k", "u_except_all", "u_intersect_all", "m1_fuse", "m6_compact_expire", "m7_replay", "olap_effect_top10", "olap_platform_effect",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
