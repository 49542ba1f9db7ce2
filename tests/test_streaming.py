"""Incremental person flags equal the batch flags, also after more files arrive."""

import uuid

from helpers import rows
from pyspark.sql import functions as F

from conftest import SMALL_SF
from vocabshift.operators import stats as S
from vocabshift.operators.resolve import resolve_concepts
from vocabshift.session import checkpoint_dir
from vocabshift.sources.fixtures import EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS, Fixtures
from vocabshift.streaming.person_flags import compact_flags, current_flags, read_event_streams, start_person_flags


def test_streaming_flags_match_batch(spark):
    fx = Fixtures(spark, SMALL_SF)
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    old_vc = resolve_concepts(fx.items, fx.old, EXCLUDED_NODES)
    new_vc = resolve_concepts(fx.items, fx.new, EXCLUDED_NODES)
    diff = S.concept_diff(S.concept_pool(old_vc, new_vc, fx.old, fx.new, INCLUDED_SOURCE_VOCABS)).cache()

    tables = fx.event_tables
    paths = {name: f"{base}/events/{name}" for name in tables}
    # first delivery: persons with even ids
    for name, df in tables.items():
        df.where("person_id % 2 = 0").write.mode("append").parquet(paths[name])
    events = read_event_streams(spark, paths)
    q = start_person_flags(events, diff, f"{base}/flags", f"{base}/ckpt", "v1")
    q.awaitTermination()
    first = current_flags(spark, f"{base}/flags", "v1")
    assert rows(first) == rows(S.person_flags(S.union_events(tables).where("person_id % 2 = 0"), diff))

    # second delivery: the rest; only new files are processed
    for name, df in tables.items():
        df.where("person_id % 2 <> 0 OR person_id IS NULL").write.mode("append").parquet(paths[name])
    q = start_person_flags(read_event_streams(spark, paths), diff, f"{base}/flags", f"{base}/ckpt", "v1")
    q.awaitTermination()
    assert rows(current_flags(spark, f"{base}/flags", "v1")) == rows(S.person_flags(S.union_events(tables), diff))
    compact_flags(spark, f"{base}/flags", "v1", 2)
    assert rows(current_flags(spark, f"{base}/flags", "v1")) == rows(S.person_flags(S.union_events(tables), diff))

    # a new vocabulary version has a log of its own
    renamed = diff.withColumn("concept_type", F.lit("added"))
    q = start_person_flags(read_event_streams(spark, paths, max_files_per_trigger=2), renamed, f"{base}/flags", f"{base}/ckpt", "v2")
    q.awaitTermination()
    assert rows(current_flags(spark, f"{base}/flags", "v2")) == rows(S.person_flags(S.union_events(tables), renamed))
    assert rows(current_flags(spark, f"{base}/flags", "v1")) == rows(S.person_flags(S.union_events(tables), diff))
    diff.unpersist()
