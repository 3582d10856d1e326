"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES (comma separated,
or "all") the queries. Each query runs once to warm up and then BENCH_RUNS times (default 1); the
median counts. Results go to a no-op sink, so that whole results are computed and nothing is
collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tabsmith.session import local_session
from workload import all_queries

HEADLINE = """corr_pearson profile_columns health_score fill_mean fill_median iqr_clip zscore_filter
standardize label_encode one_hot filter_range join_inner join_outer sql_inner_join time_features
descriptive boxplot histogram crosstab_topn corr_spearman corr_kendall corr_distance cramers_v
mic anova_oneway shapiro_francia spc_by_group target_rules auc ols ridge rf_regression kmeans mars
arima dax_rolling_period dax_rank_all pareto stream_quality_counts""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = local_session("bench", cpus)
    times = {}
    for name in names:
        measured = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
