"""Times the headline queries on a warm session, best of ``BENCH_RUNS`` (3), and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from regrowth.plans.catalogue import QUERIES  # noqa: E402
from regrowth.session import get_spark  # noqa: E402

HEADLINE = [
    "wide_to_long",
    "binned_mean_se",
    "quantiles",
    "recovery_fit",
    "strata_fits",
    "cluster_bootstrap",
    "recovery_clock_ci",
    "did_pooled",
    "event_study",
    "fe_tau_grid",
    "fe_two_way",
    "slice_sensitivity",
    "control_match",
    "unit_minus_control",
    "connected_components",
    "composite_mean",
    "composite_median",
    "stream_composite",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "regrowth-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["scan_pruned"](spark, sf_dir).collect()  # start the executor threads and the first JIT round
    times, rows, shuffled = {}, {}, {}
    for name in [q for q in HEADLINE if q in os.environ.get("BENCH_ONLY", name_all()).split(",")]:
        best = float("inf")
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            before, start = shuffle_mb(spark), time.perf_counter()
            rows[name] = QUERIES[name](spark, sf_dir).toArrow().num_rows
            best = min(best, time.perf_counter() - start)
            shuffled[name] = round(shuffle_mb(spark) - before, 2)
        times[name] = round(best, 3)
    n_rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "shuffle_mb": shuffled,
                "lineitem_rows_per_sec": {k: round(n_rows / v) for k, v in times.items() if v},
                "lineitem_rows": n_rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


def shuffle_mb(spark) -> float:
    """Shuffle bytes that the session's stages have written so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def name_all() -> str:
    return ",".join(HEADLINE)


if __name__ == "__main__":
    main()
