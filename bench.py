"""Time the analysis on the benchmark tables; prints one JSON line.

First the stage tables are built one by one from the raw tables ("stage_*"),
then the named queries run on them, each result going to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from tallywise.plans.engine import Engine, load_tables
from tallywise.plans.registry import QUERIES
from tallywise.session import build_session
from tallywise.sources.staging import Stages

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "customer_orders",
    "customer_base",
    "numeric_profile",
    "monetary_score_ranked",
    "rfm_segments",
    "rfm_segment_breakdown",
    "rfm_weight_fit",
    "bgnbd_loglik_grid",
    "expected_purchases",
    "clv_scores",
    "clv_summary",
    "clv_sensitivity",
    "current_state",
    "proposed_state",
    "retention_roi",
    "retention_headline",
    "segment_summary_export",
    "geographic_summary",
    "clv_box_stats",
    "top_states_by_clv",
)


def clock(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def new_engine() -> Engine:
        return Engine(load_tables(spark, sf_dir), Stages(spark))

    warm = new_engine()
    drain(warm.roi())

    times: dict[str, float] = {}
    stages = ("rollup", "rfm", "inputs", "sensitivity", "targeted", "roi")
    engines = [new_engine() for _ in range(RUNS)]
    for stage in stages:
        times[f"stage_{stage}"] = statistics.median(
            clock(getattr(e, stage)) for e in engines
        )
    engine = engines[-1]
    for name in HEADLINE:
        query = QUERIES[name]
        drain(query(engine))
        times[name] = statistics.median(
            clock(lambda: drain(query(engine))) for _ in range(RUNS)
        )
    print(json.dumps({
        "metric": "customer_value_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
