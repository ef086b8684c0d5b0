"""Seconds per headline query. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from touchline.catalog import REGISTRY
from touchline.session import local_session

HEADLINE = (
    "league_table", "standings_before_match_day", "table_positions", "recent_form", "elo_ratings", "prematch_feature_table",
    "sanitised_history", "file_audit", "xg_enriched", "expected_goals_and_outcomes", "rho_likelihoods",
    "config_evaluation", "source_metrics", "best_tickets", "top_double_combinations", "settled_tickets",
    "matchday_recommendations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    # One untimed query starts the workers and reads the footers.
    REGISTRY["league_table"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
