"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds a query.

Each query runs once to warm up and then ``RUNS`` times into a no-op sink; the median counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from tarn import queries
from tarn.session import make_session

RUNS = 3
#: Point, range with limit, range, scan, count and join, as a table benchmark has them, then each operator family.
HEADLINE = [
    "q01_select_project_alias",
    "q02_where_range_and",
    "q05_where_in",
    "q11_json_path_eq",
    "q16_join_inner",
    "q18_join_multi",
    "q22_agg_global",
    "q24_group_by",
    "q25_group_having",
    "q26c_join_group",
    "q28_topk_desc",
    "q29_ts_bucket_avg",
    "q42_ts_mrange_labels",
    "q47_vector_topk",
    "q49_vector_filtered",
    "q52_geo_radius",
    "q54_geo_topk",
    "q56_zset_rank",
    "q59_zunion_weighted",
    "q64_set_inter",
    "q67_hll_count",
    "q70_list_slice",
    "q77_update_where",
    "q78_delete_cascade",
    "q84_stream_range",
    "q88_live_diff",
    "q92_policy_membership",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = make_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    makers, took = queries.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            makers[name](spark, path).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
