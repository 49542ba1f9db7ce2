"""Plan shape: the scale properties the design relies on, checked on the physical plans."""

import contextlib
import io
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL_SF
from vocabshift.operators import stats as S
from vocabshift.operators.resolve import resolve_concepts
from vocabshift.plans.catalog import QUERIES
from vocabshift.sources.fixtures import EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS, Fixtures


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture()
def no_auto_broadcast(spark):
    """Plan as if every table were large: only explicit, size-checked broadcasts remain."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_events_are_filtered_by_code_below_their_first_shuffle(spark, no_auto_broadcast):
    fx = Fixtures(spark, SMALL_SF)
    old_vc = resolve_concepts(fx.items, fx.old, EXCLUDED_NODES)
    new_vc = resolve_concepts(fx.items, fx.new, EXCLUDED_NODES)
    diff = S.concept_diff(S.concept_pool(old_vc, new_vc, fx.old, fx.new, INCLUDED_SOURCE_VOCABS))
    plan = _plan(S.person_flags(S.union_events(fx.event_tables), diff, small=True))
    # the union of the event branches is the streamed side of the join with the distinct codes
    lines = plan.splitlines()
    assert any("BroadcastHashJoin Inner BuildRight" in x and ":- Union" in y for x, y in zip(lines, lines[1:], strict=False))
    # events are shuffled as distinct pairs and as (cohort, person), never by code
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[.*?\]\nArguments: hashpartitioning\((.*?)\)", plan)
    assert any("person_id" in e and "source_concept_id" in e for e in exchanges)
    assert not any(e.startswith("source_concept_id") for e in exchanges)


def test_events_are_filtered_below_their_first_shuffle_at_any_vocabulary_size(spark, no_auto_broadcast):
    from vocabshift.plans.broadcast import CONF_KEY

    spark.conf.set(CONF_KEY, "0")
    try:
        fx = Fixtures(spark, SMALL_SF)
        old_vc = resolve_concepts(fx.items, fx.old, EXCLUDED_NODES)
        new_vc = resolve_concepts(fx.items, fx.new, EXCLUDED_NODES)
        diff = S.concept_diff(S.concept_pool(old_vc, new_vc, fx.old, fx.new, INCLUDED_SOURCE_VOCABS))
        plan = _plan(S.person_flags(S.union_events(fx.event_tables), diff))
    finally:
        spark.conf.unset(CONF_KEY)
    lines = plan.splitlines()
    # the only broadcast is the code filter, and the union of the event branches streams past it
    assert any("BroadcastHashJoin Inner BuildRight" in x and ":- Union" in y for x, y in zip(lines, lines[1:], strict=False))
    assert len(re.findall(r"BroadcastExchange \(", plan)) == 1
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((.*?)\)", plan)
    events = [by for columns, by in exchanges if columns.startswith("person_id")]
    # distinct pairs first, then by code, then by person and word: the join's output is dealt anew, so AQE may split a code
    assert sorted(e.split("#")[0] for e in events) == ["person_id", "person_id", "source_concept_id"]


def test_laid_out_events_are_never_shuffled(spark, no_auto_broadcast):
    from vocabshift.sinks.events import write_event_layout
    from vocabshift.staging import Staging

    with Staging(spark, "layout") as stage:
        path = stage.folder("events")
        table = "events_" + path.rsplit("-", 1)[1]
        fx = Fixtures(spark, SMALL_SF)
        events = S.union_events(fx.event_tables)
        layout = write_event_layout(events, table, 8, path)
        codes = events.select(F.col("source_concept_id").alias("concept_id")).distinct().where("concept_id % 3 = 0")
        diff = codes.select(F.lit(1).cast("long").alias("cohort_definition_id"), "concept_id", F.lit("added").alias("concept_type"))
        flags = S.person_flags(layout, diff, small=True)
        plan = _plan(flags)
        assert "Bucketed: true" in plan
        assert not re.search(r"\) Exchange\nInput \[\d+\]: \[person_id", plan)
        assert sorted(flags.collect()) == sorted(S.person_flags(events, diff, small=True).collect())
        spark.sql(f"drop table {table}")


def test_code_filter_keeps_all_codes_and_few_others(spark):
    codes = spark.range(0, 50_000, 5).select(F.col("id").alias("concept_id"))
    events = spark.range(50_000).select(F.lit(1).alias("person_id"), F.col("id").alias("source_concept_id"))
    for blocks, most in ((1 << 12, 600), (4, 40_001)):  # a filter far too small passes more, and loses nothing
        assert S.code_filter(codes, blocks).count() <= blocks
        passed = S.filtered_events(events, codes, blocks)
        right = passed.where("source_concept_id % 5 = 0").count()
        assert right == 10_000 and passed.count() - right <= most
    none = events.select("person_id", F.lit(None).cast("long").alias("source_concept_id"))
    assert S.filtered_events(none, codes).count() == 0


def _jobs(spark, build) -> list[int]:
    """Jobs that building starts."""
    group = f"build-{id(build)}"
    spark.sparkContext.setJobGroup(group, "build")
    try:
        build()
        return list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


REPORTS = ("nonstandard_nodes_report", "mapping_diff", "domain_change_report", "cohort_stats", "pair_mapping_diff", "pair_domain_change")


def _report_set(spark, tables, **kw):
    from vocabshift import vocabulary_change_report
    from vocabshift.sources.fixtures import inputs_for

    fx = inputs_for(spark, tables)
    return vocabulary_change_report(
        fx.items, fx.old, fx.new, fx.concept_count, fx.event_tables, fx.cohort_names, EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS, **kw
    )


def test_building_reports_without_staging_starts_no_job_and_leaves_nothing(spark, tables):
    from vocabshift import cohort_pair_report
    from vocabshift.sources.fixtures import inputs_for

    spark.catalog.clearCache()
    fx = inputs_for(spark, tables)
    reports = _report_set(spark, tables, materialize="none")
    pair = cohort_pair_report(fx.items, fx.items_updated, fx.cohort_map, fx.old, fx.new, fx.concept_count, materialize="none")
    for made in (reports, pair):
        for name in made:
            assert _jobs(spark, lambda: made[name]) == []  # noqa: B023
    reports["mapping_diff"].count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty() and not reports.staging.paths


def test_only_shared_sides_are_persisted_and_released(spark, tables):
    spark.catalog.clearCache()
    with _report_set(spark, tables, materialize="persist") as reports:
        for name in reports:
            reports[name].count()
        assert len(reports.held) == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_shared_subplans_are_written_once_and_removed_with_the_set(spark, tables):
    with _report_set(spark, tables) as reports:
        for name in reports:
            reports[name].count()
        paths = [p.removeprefix("file:") for p in reports.staging.paths]
        assert len(paths) == 4  # two resolved sides and two differences
        assert all(os.path.isdir(p) for p in paths)
    assert not any(os.path.exists(p) for p in paths)
    with _report_set(spark, tables, reports=["mapping_diff"]) as reports:
        reports["mapping_diff"].count()
        assert len(reports.staging.paths) == 1  # sides with one reader are not written


def test_the_difference_reads_items_and_hierarchy_once_a_version(spark, tables):
    """The staged difference is one plan with one scan of each; what reads it scans neither."""
    from vocabshift.operators import diff as D
    from vocabshift.sources.fixtures import inputs_for

    fx = inputs_for(spark, tables)
    sides = [D.source_concepts(resolve_concepts(fx.items, v, EXCLUDED_NODES), v) for v in (fx.old, fx.new)]
    scans = _scans(_plan(D.source_concept_diff(*sides)))
    assert sum("/items]" in s for s in scans) == 2
    assert [sum(f"/ancestor_{v}]" in s for s in scans) for v in ("old", "new")] == [1, 1]
    for name in ("mapping_diff", "cohort_stats", "pair_mapping_diff"):
        scans = _scans(_plan(QUERIES[name](spark, tables)))
        assert scans and not any("/items" in s or "/ancestor_" in s for s in scans), name


def test_mapping_report_scans_each_table_once_per_use(spark, tables):
    scans = _scans(_plan(QUERIES["mapping_diff"](spark, tables)))
    assert sum("concept_count" in s for s in scans) == 1
    named = [s for s in scans if "concept_name" in s]
    assert len(named) <= 3  # details and new targets, old targets


def test_node_report_reads_the_relationships_once(spark, tables):
    scans = _scans(_plan(QUERIES["nonstandard_nodes"](spark, tables)))
    assert sum("relationship_new" in s for s in scans) == 1


def test_reports_are_sorted_by_more_than_one_column(spark, tables):
    for name in REPORTS:
        plan = _plan(QUERIES[name](spark, tables))
        order = re.findall(r"Arguments: rangepartitioning\((.*)\), ENSURE", plan)
        assert order and all(o.count(" NULLS ") > 1 for o in order), name


@pytest.fixture(scope="module")
def tables(spark):
    """The fixture inputs written as Parquet tables (so the plans have real scans)."""
    import uuid

    from vocabshift.session import checkpoint_dir
    from vocabshift.sources.fixtures import write_inputs

    return write_inputs(Fixtures(spark, SMALL_SF), f"{checkpoint_dir(spark).rstrip('/')}/plans-{uuid.uuid4().hex}")


def _scans(plan: str) -> list[str]:
    return re.findall(r"\(\d+\) Scan parquet.*?\n\n", plan, re.S)


def test_predicates_and_pruning_reach_the_scans(spark, tables):
    plan = _plan(QUERIES["nonstandard_nodes"](spark, tables))
    scans = _scans(plan)
    rel = [s for s in scans if "relationship_new" in s]
    assert rel and all("In(relationship_id, [Maps to,Maps to value]" in s for s in rel)
    assert all("IsNull(invalid_reason)" in s for s in rel)
    con = [s for s in scans if "concept_new" in s]
    assert any("IsNull(standard_concept)" in s for s in con)
    # column pruning: no scan reads the whole concept row
    assert all("concept_code" not in s.split("ReadSchema:")[1] for s in con)


def test_mapping_scans_push_edge_type_and_validity(spark, tables):
    plan = _plan(QUERIES["mapping_diff"](spark, tables))
    rel = [s for s in _scans(plan) if "relationship_" in s]
    assert rel
    for s in rel:
        assert "EqualTo(relationship_id," in s and "IsNull(invalid_reason)" in s
        assert "ReadSchema: struct<concept_id_1:bigint,concept_id_2:bigint,relationship_id:string,invalid_reason:string>" in s


def test_no_cross_or_nested_loop_joins(spark):
    for name in ("mapping_diff", "domain_change", "cohort_stats", "pair_mapping_diff", "nonstandard_nodes"):
        plan = _plan(QUERIES[name](spark, SMALL_SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_python_udfs_in_reports(spark):
    for name in ("mapping_diff", "domain_change", "cohort_stats", "nonstandard_nodes"):
        plan = _plan(QUERIES[name](spark, SMALL_SF))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
