"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line.

Every query runs once to warm the session and then BENCH_RUNS times (default 3); the median counts. Results are
materialised in full by a `noop` write, so no column or row is skipped.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import functions as F  # noqa: E402

from wirefold.operators import bootstrap, drift, thresholds  # noqa: E402
from wirefold.plans.fixtures import table  # noqa: E402
from wirefold.registry import collect  # noqa: E402
from wirefold.session import build_session  # noqa: E402

REGISTERED = ["flows", "flow_statistics", "label_align", "flow_features", "accounting", "alert_flow_match",
              "packet_assign", "packet_sequences", "join_check", "overlap", "fusion", "subset_degradation"]
BY = ["domain", "method"]


def on_lineitem(op):
    """Threshold work on about three score rows per lineitem row."""
    return lambda spark, sf: op(table(spark, sf, "bench_long_scores"))


def bench_queries():
    q = {n: f for n, f in collect("QUERIES").items() if n in REGISTERED}
    q = {n: q[n] for n in REGISTERED}
    q["sweep_best_f1"] = on_lineitem(lambda s: thresholds.best_f1(thresholds.sweep(s, BY), BY))
    q["fixed_fpr"] = on_lineitem(lambda s: thresholds.fixed_fpr(s, BY))
    q["roc_pr_auc"] = on_lineitem(lambda s: thresholds.ranking_metrics(s, BY))
    q["threshold_analysis"] = on_lineitem(lambda s: thresholds.analyze(s, ["method"]))
    q["bootstrap_f1_1000"] = on_lineitem(lambda s: bootstrap.bootstrap_f1(s, BY))
    q["ks_w1"] = lambda spark, sf: drift.distances(
        drift.unpivot(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                      ["l_linestatus"]), ["feature"], "value", F.col("l_linestatus") == "O")
    return q


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
                          spark_driver_memory="16g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name, fn in bench_queries().items():
        if only and name not in only:
            continue
        took = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
