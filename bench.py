"""Times the headline queries; prints one JSON line.

The warehouse and the raw tables are written beforehand, as they would be in
use; ``warehouse_build`` makes all five tables anew. Queries of under a few
seconds are run once unmeasured and then timed as the median of three runs, the
others are timed in one run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlake.operators.cleaning import apply_rules, recommend_rules, rules_list  # noqa: E402
from ledgerlake.operators.isolation import detect_anomalies  # noqa: E402
from ledgerlake.operators.profile import Profile  # noqa: E402
from ledgerlake.operators.quality import quality_scores  # noqa: E402
from ledgerlake.operators.timeseries import fit_sales_model  # noqa: E402
from ledgerlake.plans import dashboard, warehouse  # noqa: E402
from ledgerlake.registry.data import folder  # noqa: E402
from ledgerlake.session import local_session  # noqa: E402
from ledgerlake.sources.workbook import POSITION  # noqa: E402

SHORT = 3.0


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    f = folder(spark, path)
    star, dirty = f.star, f.dirty

    def full_profile():
        profile = Profile(dirty.drop(POSITION))
        for part in (profile.columns(), profile.histograms(), profile.correlations(), quality_scores(profile)):
            part.collect()

    def clean():
        rules = rules_list(recommend_rules(Profile(dirty.drop(POSITION))))
        rows, _ = apply_rules(dirty, rules, POSITION)
        rows.write.format("noop").mode("overwrite").save()

    def forecast():
        model = fit_sales_model(f.monthly)
        model.forecast().collect()
        model.metrics().collect()

    jobs = {
        "revenue_by_category": lambda: dashboard.category_performance(star).collect(),
        "dashboard_kpis": lambda: dashboard.kpis(star.fact_sales).collect(),
        "monthly_trend": lambda: dashboard.monthly_trend(star).collect(),
        "top_products": lambda: dashboard.top_products(star).collect(),
        "warehouse_build": lambda: warehouse.build_warehouse(f.clean),
        "rfm_tiers": lambda: warehouse.rfm_scores(warehouse.customer_activity(f.clean)).collect(),
        "full_profile": full_profile,
        "cleaning_all_rules": clean,
        "forecast": forecast,
        "isolation_forest": lambda: detect_anomalies(star.fact_sales, star.dim_products).metrics().collect(),
    }
    times = {}
    for name, job in jobs.items():
        taken = timed(job)
        if taken < SHORT:
            taken = statistics.median(timed(job) for _ in range(3))
        times[name] = round(taken, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "sum of query seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(path.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
