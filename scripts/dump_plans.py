"""Write the formatted physical plans of the headline reports to a folder.

Automatic broadcast is switched off, so the plans show what Spark does when
every table is too large for it: only the explicit, byte-bounded broadcasts
remain.  Inputs: the fixture tables of one scale factor written as Parquet
(into the session's checkpoint folder).

    python scripts/dump_plans.py OUT_FOLDER [/root/testdata/sf0.01]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import uuid

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

REPORTS = ("nonstandard_nodes", "mapping_diff", "domain_change", "cohort_stats", "pair_mapping_diff", "pair_domain_change")


def main() -> None:
    out = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    from vocabshift.plans.catalog import QUERIES
    from vocabshift.session import build_session, checkpoint_dir
    from vocabshift.sources.fixtures import Fixtures, write_inputs

    spark = build_session(
        master="local[8]",
        shuffle_partitions=8,
        **{
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    inputs = write_inputs(Fixtures(spark, sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/plans-{uuid.uuid4().hex}")
    os.makedirs(out, exist_ok=True)
    for name in REPORTS:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            QUERIES[name](spark, inputs).explain("formatted")
        with open(os.path.join(out, f"{name}.txt"), "w") as fh:
            fh.write(buf.getvalue())
    spark.stop()


if __name__ == "__main__":
    main()
