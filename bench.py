"""Seconds of the headline queries on $BENCH_SF_DIR, as one JSON line."""

from __future__ import annotations

import json
import os
import time

from scissile.plans import structures
from scissile.tables import session

NAMES = [
    "fingerprint_screen", "connected_combs_n", "fragment_edges", "property_screen", "canonical_distinct", "bb_browse", "set_algebra", "stage_counts", "exact_cover", "rule_cuts", "canonical_classes", "strict_matches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        structures.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
