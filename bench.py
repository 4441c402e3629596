"""Headline graph queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "g01_region_customers", "g04_edge_props", "g05_pricing_summary", "g06_fk_traverse", "g07_four_hops", "g59_optional_match_whole", "g10_multi_source_type", "g60_multi_type_whole", "g13_uniqueness_two_hops", "g14_vlp_range", "g15_vlp_chain", "g18_shortest_path",
    "g20_exists_pattern", "g21_not_exists", "g23_pattern_count", "g24_pattern_comprehension", "g25_with_having", "g26_with_match", "g31_distinct", "g32_order_skip_limit", "g36_temporal", "g39_aggregates", "g42_polymorphic", "g43_virtual_node", "g51_vector_search",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from graphloom.suite.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf_dir).collect()  # starts the JVM's machinery
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
