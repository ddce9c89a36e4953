"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from allotment.session import local_session

HEADLINE = ["order_cost_exact", "order_cost_paths", "customer_cost_exact", "full_permutation_mean", "ratio_zero_filled",
            "coupled_linear", "complementary", "group_testing", "gels", "differential", "kernel_shap", "truncated_permutation_mean",
            "latin_square_mean", "attribute_greedy_by_size", "attribute_complete_orbits", "customer_power_index",
            "basket_supplier_exact", "basket_supplier_paths", "channel_credit_exact", "rmse_summary"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 16)
    from allotment.catalog import QUERIES
    spark.range(1).count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
