"""Headline queries, one JSON line: python bench.py (BENCH_SF_DIR, BENCH_CPUS)."""

from __future__ import annotations

import json
import os
import sys
import time

from tessera import plans
from tessera.session import build_session

#: The published baseline's query shapes, and some heavier ones.
NAMES = (
    "lineitem_count q1_pricing_summary q3_shipping_priority q5_graph_count q5_local_supplier_revenue q6_discounted_revenue q10_returned_items "
    "q11_important_suppliers q12_order_lines_by_date part_filter_count q18_large_orders q19_discounted_or q21_sibling_exists_count shipdate_year_count topn_all text_search"
).split()


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in NAMES:
        runs = []
        for _ in range(4):  # the first warms up
            start = time.perf_counter()
            plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(sorted(runs[1:])[1], 4)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()
    sys.stdout.flush()


if __name__ == "__main__":
    main()
