"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries"
(seconds per query), "sf"}.  Each query is executed in full with the ``noop``
sink (all rows computed, nothing collected to the driver); one untimed
warm-up query runs first so JVM start-up is not billed to a query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "agg16_fold_summary",        # flagship: best epoch -> confusion -> AUC -> fold summary
    "agg18_fold_metrics",
    "agg23_pooled_metrics",
    "met03_cross_entropy",
    "met14_null_model",
    "met15_correctness_table",
    "crv01_roc_curve",
    "crv03_mean_roc",
    "crv08_threshold_sweep",
    "crv13_sliding_windows",
    "crv14_cumulative_mean",
    "agg12_confusion_rollup",
    "joi06_lookup_default",
    "top01_top_terms",
    "spl03_stratified_kfold",
    "den06_density_map",
    "sta01_avg_ranks",
    "sta06_friedman",
    "sta14_mantel",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from varlens.plans.catalog import queries
    from varlens.session import build_session

    spark = build_session(app_name="varlens-bench")
    qs = queries()
    names = [n for n in HEADLINE if n in qs]
    qs["met02_predicted_class"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
