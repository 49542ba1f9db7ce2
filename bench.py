"""Benchmark: headline reports over the fixture tables of one scale factor.

Prints ONE JSON line:
  {"metric": "...", "value": <sum of medians>, "unit": "sec", "queries": {...}, "sf": ...}

Method: the fixture inputs (two vocabulary versions, items, counts, six
event tables) are first written once as Parquet tables, the form real
inputs have; each report then reads them and is written in full to the
``noop`` sink (all rows computed, nothing stored); one warm-up run, then
the median of three.
Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1),
``BENCH_CPUS`` (default 8), ``BENCH_QUERIES`` (comma list, optional),
``BENCH_RUNS`` (default 3).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = (
    "nonstandard_nodes",
    "mapping_diff",
    "domain_change",
    "cohort_stats",
    "pair_mapping_diff",
    "pair_domain_change",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from vocabshift.session import build_session

    spark = build_session(
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        **{
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vocabshift.plans.catalog import QUERIES
    from vocabshift.session import checkpoint_dir
    from vocabshift.sources.fixtures import Fixtures, write_inputs

    t0 = time.perf_counter()
    inputs = f"{checkpoint_dir(spark).rstrip('/')}/bench-inputs-{os.getpid()}"
    write_inputs(Fixtures(spark, sf_dir), inputs)
    prepare = round(time.perf_counter() - t0, 3)

    def run_once(name: str) -> float:
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        QUERIES[name](spark, inputs).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    results = {}
    for name in names:
        run_once(name)  # warm-up
        results[name] = round(statistics.median(run_once(name) for _ in range(runs)), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "median seconds per report (noop write), summed over headline reports",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": float(m.group(1)) if m else sf_dir,
                "config": {"master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "runs": runs},
                "input_preparation_sec": prepare,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
