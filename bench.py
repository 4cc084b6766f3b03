"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from pairlake.plans import QUERIES, Tables
from pairlake.session import local_session

HEADLINES = (
    "l3_leak_join",
    "l5_greedy_dedupe",
    "l1_exact_dedupe",
    "r3_results_match",
    "r3_ordered_match",
    "r4_ordered_hash",
    "r1_canonical_lineitem",
    "v2_self_consistency_vote",
    "e1_outcomes",
    "e4_score_summary",
    "e5_latency_percentiles",
    "c3_cascade_by_set",
    "i6_example_values",
    "n1_normalize_question",
    "n14_batch_packing",
    "l14_sequence_ids",
    "q3_revenue_by_segment",
    "q4_four_way_join",
    "q4_customer_supplier_nations",
    "q6_lag",
    "q6_running_total",
    "q9_top_per_group",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start the engine outside the clock

    def control() -> float:
        """A fixed piece of plain Spark work: what the machine is worth at the moment."""
        start = time.perf_counter()
        lines = spark.read.parquet(f"{folder}/lineitem.parquet")
        lines.groupBy("l_orderkey").agg({"l_extendedprice": "sum"}).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    control()
    controls, seconds = [control()], {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    controls.append(control())
    unit = sum(controls) / len(controls)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "control": round(unit, 3),
                "value_in_controls": round(sum(seconds.values()) / unit, 1),
                "sf": folder.rstrip("/").split("sf")[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
