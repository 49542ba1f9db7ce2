"""Properties of the reports on the fixture tables (sf0.001)."""

import pytest
from helpers import rows

from conftest import SMALL_SF
from vocabshift import vocabulary_change_report
from vocabshift.operators import diff as D
from vocabshift.operators import resolve as R
from vocabshift.sources.fixtures import EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS, Fixtures


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SMALL_SF)


def test_person_partition(fx):
    rep = vocabulary_change_report(
        fx.items, fx.old, fx.new, fx.concept_count, events=fx.event_tables, cohort_names=fx.cohort_names,
        excluded_nodes=EXCLUDED_NODES, included_source_vocabs=INCLUDED_SOURCE_VOCABS,
    )
    stats = rep["cohort_stats"].collect()
    assert stats
    for s in stats:
        assert s.total_persons == s.same_persons + s.new_persons + s.lost_persons
        assert s.same_persons_potential_index_misclassification == s.same_persons - s.same_persons_no_change
    ratios = [s.same_persons_no_change / s.total_persons for s in stats]
    assert ratios == sorted(ratios)


def test_one_pass_forms_equal_set_operations(fx):
    for v in (fx.old, fx.new):
        assert rows(R.resolve_concepts(fx.items, v, EXCLUDED_NODES)) == rows(
            R.resolve_concepts_two_pass(fx.items, v, EXCLUDED_NODES)
        )
    old_sc = D.source_concepts(R.resolve_concepts(fx.items, fx.old, EXCLUDED_NODES), fx.old)
    new_sc = D.source_concepts(R.resolve_concepts(fx.items, fx.new, EXCLUDED_NODES), fx.new)
    one = rows(D.source_concept_diff(old_sc, new_sc))
    assert one == rows(D.source_concept_diff_two_pass(old_sc, new_sc))
    removed = {r[:-1] for r in one if r[-1] == "Removed"}
    added = {r[:-1] for r in one if r[-1] == "Added"}
    assert removed and added and not (removed & added)
    # swapping the versions swaps the actions
    swapped = rows(D.source_concept_diff(new_sc, old_sc))
    flip = {"Removed": "Added", "Added": "Removed"}
    assert swapped == sorted(((*r[:-1], flip[r[-1]]) for r in one), key=repr)


def test_identical_versions_change_nothing(fx):
    rep = vocabulary_change_report(
        fx.items, fx.new, fx.new, fx.concept_count, excluded_nodes=EXCLUDED_NODES,
    )
    assert rep["mapping_diff"].count() == 0
    assert rep["domain_change"].count() == 0
    assert rep["nonstandard_nodes"].count() > 0


@pytest.mark.parametrize("mode", ["checkpoint", "none"])
def test_materialize_modes_give_same_reports(fx, mode):
    args = (fx.items, fx.old, fx.new, fx.concept_count)
    kw = dict(events=fx.event_tables, excluded_nodes=EXCLUDED_NODES, included_source_vocabs=INCLUDED_SOURCE_VOCABS)
    base = vocabulary_change_report(*args, **kw)
    other = vocabulary_change_report(*args, materialize=mode, **kw)
    for name in ("mapping_diff", "cohort_stats"):
        assert rows(base[name]) == rows(other[name])
    base.close()
    assert base.held == []


def test_event_join_with_and_without_broadcast(fx):
    from vocabshift.operators import stats as S

    old_vc = R.resolve_concepts(fx.items, fx.old, EXCLUDED_NODES)
    new_vc = R.resolve_concepts(fx.items, fx.new, EXCLUDED_NODES)
    diff = S.concept_diff(S.concept_pool(old_vc, new_vc, fx.old, fx.new, INCLUDED_SOURCE_VOCABS))
    events = S.union_events(fx.event_tables)
    assert rows(S.person_flags(events, diff, small=True)) == rows(S.person_flags(events, diff, small=False))
    assert rows(S.matched_events(events, diff, small=True)) == rows(S.matched_events(events, diff, small=False))


@pytest.mark.parametrize("changed_only", [False, True])
def test_one_pass_mapping_diff_equals_two_sided_join(fx, changed_only):
    from vocabshift.operators import mapping as M

    old_sc = D.source_concepts(R.resolve_concepts(fx.items, fx.old, EXCLUDED_NODES), fx.old)
    new_sc = D.source_concepts(R.resolve_concepts(fx.items, fx.new, EXCLUDED_NODES), fx.new)
    dif = D.source_concept_diff(old_sc, new_sc)
    mapped_old = M.mapping_old(dif, fx.old, fx.new, fx.concept_count, included_source_vocabs=INCLUDED_SOURCE_VOCABS)
    old_agg = M.aggregate_mapping(mapped_old, M.old_aggregate_keys(), "old")
    new_agg = M.aggregate_mapping(M.mapping_new(dif, fx.new), M.new_aggregate_keys(), "new")
    two = M.mapping_diff(old_agg, new_agg, changed_only=changed_only)
    one = M.mapping_diff_one_pass(
        dif, fx.old, fx.new, fx.concept_count, included_source_vocabs=INCLUDED_SOURCE_VOCABS, changed_only=changed_only
    )
    assert one.columns == two.columns
    assert rows(one) == rows(two)


def test_summary_from_flags_equals_histogram_form(spark):
    from helpers import df

    from vocabshift.operators import stats as S

    flags = df(
        spark,
        [(7, 1, 1, 0, 0), (7, 2, 0, 1, 1), (7, 3, 0, 1, 0), (7, None, 1, 1, 1), (8, 4, 0, 0, 1), (8, 5, 1, 1, 0)],
        "cohort_definition_id bigint, person_id bigint, has_same int, has_new int, has_old int",
    )
    assert rows(S.person_change_summary_from_flags(flags)) == rows(S.person_change_summary(S.flag_histogram(flags)))


def test_reports_equal_when_no_side_may_be_broadcast(spark, fx):
    """With a bound of 0 bytes no side gets a hint, and the reports are the same."""
    from vocabshift import cohort_pair_report
    from vocabshift.plans.broadcast import CONF_KEY

    def run():
        main = vocabulary_change_report(
            fx.items, fx.old, fx.new, fx.concept_count, events=fx.event_tables, cohort_names=fx.cohort_names,
            excluded_nodes=EXCLUDED_NODES, included_source_vocabs=INCLUDED_SOURCE_VOCABS, materialize="none",
        )
        pair = cohort_pair_report(
            fx.items, fx.items_updated, fx.cohort_map, fx.old, fx.new, fx.concept_count,
            EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS, materialize="none",
        )
        out = {name: rows(main[name]) for name in main}
        out.update({f"pair_{name}": rows(pair[name]) for name in pair})
        return out

    spark.catalog.clearCache()  # start from a session without data persisted by earlier tests
    default = run()
    spark.conf.set(CONF_KEY, "0")
    try:
        forced = run()
    finally:
        spark.conf.unset(CONF_KEY)
    assert default.keys() == forced.keys()
    for name in default:
        assert default[name] == forced[name], name
