"""Times the headline queries: prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lodetrace.plans import catalog

QUERIES = ["df_pairs_userday", "df_pairs_context_userday", "variants_userday", "eventually_follows_userday", "footprint_alpha_status", "dependencies_yearly",
           "tree_vertices_userday", "state_as_of_events", "guard_outcomes_events", "alpha_net_arcs_conversations"]


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, times = catalog.queries(), {}
    for name in QUERIES:
        runs = []
        for _ in range(4):
            began = time.time()
            made[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs[1:]), 3)  # the first run compiles
    print(json.dumps({"metric": "warm median of headline queries, summed", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
