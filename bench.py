"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.queries import QUERIES

HEADLINE = (
    "count_star", "scan_filter", "group_multi", "sum_avg_min_max", "agg_filter_pivot", "count_distinct", "having_agg", "group_case", "expr_project",
    "distinct_cols", "case_searched", "orderby_limit_topk", "qualify_topn", "time_bucket_label", "as_of_latest", "scd2_gauge_series", "match_candidates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in HEADLINE:  # once to load files and compile
        run(name)
    times = {name: round(min(run(name) for _ in range(3)), 4) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
