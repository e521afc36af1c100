"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cardwarden.plans.queries import REGISTRY
from cardwarden.session import build_session

HEADLINE = [
    "asof_features", "asof_features_6h", "late_asof", "card_features", "feature_vector",
    "parse_tx", "encode_risk", "dedupe_key", "history_semi", "train_window_delayed",
    "train_bags", "batch_top100", "daily_alerts", "feedback_window", "batch_metrics",
    "train_delayed", "score_delayed", "train_feedback", "score_feedback",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the JVM, the compiler and the file system is not part of any query.
    REGISTRY["asof_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
