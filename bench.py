"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orbisweep import constants as C
from orbisweep.operators import propagate, screen
from orbisweep.plans.queries import QUERIES
from orbisweep.session import build_session, materialize
from orbisweep.sources import derived

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = [
    "category_regimes", "catalog_scan", "asof_latest", "category_counts", "orbital_elements", "final_state",
    "cell_occupancy", "grid_pairs", "conjunctions", "screening_stats", "hourly_tumbling", "breakup_events",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", spark__sql__shuffle__partitions=2 * int(CPUS), spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, build):
        t0 = time.time()
        drain(build())
        seconds[name] = round(time.time() - t0, 3)

    drain(derived.objects(spark, SF_DIR))  # start the JVM's and Python's engines
    objects = materialize(derived.objects(spark, SF_DIR), "bench")
    # one hour at 10 s per step, every object
    timed("propagate_1h_dt10", lambda: propagate.advance(objects, C.DEFAULT_EPOCH_JD, 10.0, 0, 360))
    # ten minutes at 30 s per step, every object against every other
    timed("screen_10min_dt30", lambda: screen.screen(objects, C.DEFAULT_EPOCH_JD, 30.0, 0, 20))
    for name in NAMES:
        timed(name, lambda: QUERIES[name](spark, SF_DIR))
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "objects": objects.count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
