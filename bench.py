"""Seconds per headline query, best of two runs each, written to a sink that keeps nothing. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from matchframe.plans import all_queries
from matchframe.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "values_asof", "rankings_asof", "rolling_form", "match_form", "rolling_means", "squad_features", "lineup_features",
    "partial_links", "cascade_links", "elo_ratings", "walk_forward_ratings", "outcome_probs", "three_way_scores",
]


def main() -> None:
    spark = local_session(CPUS, "bench", memory="16g")
    known = all_queries()
    known["outcomes"].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            known[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
