"""Edge rows: the easy-to-get-wrong semantics, one small table each."""

import pytest
from helpers import COUNTS, ITEMS, df, maps, rows, vocab

from vocabshift import cohort_pair_report, normalise_items, vocabulary_change_report
from vocabshift.functions.aggregate import ordered_join_columns
from vocabshift.operators import resolve as R
from vocabshift.operators import stats as S

KEYS = ("cohortid", "cohortname", "conceptsetname", "conceptsetid")


def _std(cid, name=None, domain="Condition"):
    return (cid, name or f"c{cid}", domain, "SNOMED", "S", f"S{cid}")


def _src(cid, vocab_id="ICD10CM", name=None):
    return (cid, name or f"s{cid}", "Condition", vocab_id, None, f"X{cid}")


def _tree():
    # 1 -> 2 -> 3 ; 1 -> 4 ; closure with self rows (5 has no self row)
    anc = [(1, 1), (2, 2), (3, 3), (4, 4), (1, 2), (1, 3), (2, 3), (1, 4), (5, 3)]
    return [_std(i) for i in (1, 2, 3, 4, 5)], anc


def _items(spark, *items):
    return df(spark, [(*it, 1, "s", 7, "c") for it in items], ITEMS)


def _resolved(spark, items, excluded=()):
    concepts, anc = _tree()
    v = vocab(spark, concepts, anc)
    return sorted(r.descendant_concept_id for r in R.resolve_concepts(items, v, excluded).collect())


def test_exclusion_applies_to_resolved_descendants(spark):
    # include 1 with descendants, exclude 2 with descendants -> 1 and 4 remain
    assert _resolved(spark, _items(spark, (1, 0, 1), (2, 1, 1))) == [1, 4]
    # exclude 2 without descendants -> only 2 removed
    assert _resolved(spark, _items(spark, (1, 0, 1), (2, 1, 0))) == [1, 3, 4]


def test_excluded_nodes_only_drop_the_include_branch(spark):
    items = _items(spark, (1, 0, 1), (2, 1, 0), (2, 0, 0))
    # 2 listed as excluded node: its include row is dropped, its exclude row still subtracts
    assert _resolved(spark, items, excluded=[2]) == [1, 3, 4]


def test_node_without_self_row_or_concept(spark):
    # 5 has no self row: resolves to nothing without descendants, to 3 with them
    assert _resolved(spark, _items(spark, (5, 0, 0))) == []
    assert _resolved(spark, _items(spark, (5, 0, 1))) == [3]
    # 9 is absent from concept: nothing at all
    assert _resolved(spark, _items(spark, (9, 0, 1))) == []


def test_null_and_boolean_flags(spark):
    raw = spark.createDataFrame(
        [(1, False, True, 1, "s", 7, "c"), (2, True, True, 1, "s", 7, "c"), (3, None, False, 1, "s", 7, "c")],
        "ConceptID bigint, isExcluded boolean, includeDescendants boolean, conceptsetId bigint, "
        "conceptsetName string, cohortId bigint, cohortName string",
    )
    items = normalise_items(raw)
    assert dict(items.dtypes)["isexcluded"] == "int"
    # NULL isexcluded on 3: neither include nor exclude
    assert _resolved(spark, items) == [1, 4]
    null_desc = _items(spark, (1, 0, None))
    assert _resolved(spark, null_desc.withColumn("includedescendants", null_desc.includedescendants.cast("int"))) == []


def _nodes_vocab(spark):
    concepts = [
        (10, "node", "Condition", "SNOMED", None, "n"),
        (11, "classification", "Condition", "SNOMED", "C", "c"),
        _std(20), _std(21), _std(30), _std(31),
    ]
    rel = maps(10, 20) + maps(10, 21) + [(10, 30, "Maps to value", None), (10, 31, "Maps to value", None)]
    rel += [(10, 99, "Maps to", "D")]  # invalid edge is ignored
    return vocab(spark, concepts, [], rel)


def test_nonstandard_nodes_fan_out_and_keep_duplicates(spark):
    new = _nodes_vocab(spark)
    items = _items(spark, (10, 0, 1), (10, 1, 0), (11, 0, 1))
    counts = df(spark, [], COUNTS)
    out = vocabulary_change_report(items, new, new, counts)["nonstandard_nodes"]
    got = rows(out)
    # 2 items of node 10 x (2 Maps to x 2 Maps to value); the 'C' node is not reported
    assert len(got) == 8
    assert {r[8] for r in got} == {0}  # drc defaults to 0
    assert {(r[9], r[11]) for r in got} == {(20, 30), (20, 31), (21, 30), (21, 31)}


def test_ordered_join_na_last_and_aligned(spark):
    data = df(
        spark,
        [(1, 30, "alpha", "V", "c30"), (1, 20, "zulu", "V", "c20"), (1, None, None, None, None), (2, None, None, None, None)],
        "k int, concept_id bigint, concept_name string, vocabulary_id string, concept_code string",
    )
    out = data.groupBy("k").agg(
        *ordered_join_columns("concept_id", ("concept_id", "concept_name", "vocabulary_id", "concept_code"), "m_")
    )
    got = {r.k: (r.m_concept_id, r.m_concept_name, r.m_concept_code) for r in out.collect()}
    assert got[1] == ("20-30-NA", "zulu-alpha-NA", "c20-c30-NA")
    assert got[2] == ("NA", "NA", "NA")


def _two_set_vocabs(spark):
    concepts = [_std(1), _std(2), _src(100), _src(101)]
    anc = [(1, 1), (2, 2)]
    old = vocab(spark, concepts, anc, maps(100, 1) + maps(101, 1))
    new = vocab(spark, concepts, anc, maps(100, 2) + maps(101, 1))
    return old, new


def test_code_moved_between_sets_of_one_cohort(spark):
    old, new = _two_set_vocabs(spark)
    items = df(spark, [(1, 0, 0, 1, "a", 7, "c"), (2, 0, 0, 2, "b", 7, "c")], ITEMS)
    counts = df(spark, [(100, 5, 5), (101, 6, 6)], COUNTS)
    events = df(spark, [(1, 100), (2, 101), (None, 100)], "person_id bigint, source_concept_id bigint")
    rep = vocabulary_change_report(items, old, new, counts, events=events)
    diff = {(r.conceptsetid, r.source_concept_id, r.action) for r in rep["mapping_diff"].collect()}
    assert diff == {(1, 100, "Removed"), (2, 100, "Added")}
    stats = rep["cohort_stats"].collect()
    assert len(stats) == 1
    s = stats[0]
    # code 100 is 'same' at cohort level; NULL person counts 0
    assert (s.total_persons, s.same_persons, s.same_persons_no_change, s.new_persons, s.lost_persons) == (2, 2, 2, 0, 0)
    assert (s.same_concepts_count, s.removed_concepts_count, s.added_concepts_count) == (2, 0, 0)
    assert s.cohortname is None  # no names table given


def test_cohort_without_events_is_absent_from_stats(spark):
    old, new = _two_set_vocabs(spark)
    items = df(spark, [(1, 0, 0, 1, "a", 7, "c"), (2, 0, 0, 1, "a", 8, "d")], ITEMS)
    counts = df(spark, [], COUNTS)
    events = df(spark, [(1, 101)], "person_id bigint, source_concept_id bigint")
    names = df(spark, [(7, "seven")], "cohortid bigint, cohortname string")
    stats = vocabulary_change_report(items, old, new, counts, events=events, cohort_names=names)["cohort_stats"]
    got = {(r.cohort_definition_id, r.cohortname) for r in stats.collect()}
    # cohort 8 gains code 100 but no event carries it, so it has no stats row
    assert got == {(7, "seven")}


def test_pair_renamed_set_and_two_new_cohorts(spark):
    old, new = _two_set_vocabs(spark)
    items_old = df(spark, [(1, 0, 0, 1, "a", 7, "c")], ITEMS)
    items_new = df(spark, [(1, 0, 0, 1, "renamed", 107, "c"), (1, 0, 0, 1, "a", 207, "c")], ITEMS)
    cmap = df(spark, [(7, 107, "v0"), (7, 207, "v0")], "old_cohort_id bigint, new_cohort_id bigint, old_cohort_vocab_version string")
    counts = df(spark, [(100, 5, 5), (101, 6, 6)], COUNTS)
    rep = cohort_pair_report(items_old, items_new, cmap, old, new, counts, changed_only=False)
    got = {(r.conceptsetname, r.source_concept_id, r.action, r.new_cohort_id) for r in rep["mapping_diff"].collect()}
    # the renamed set shows its codes as Added; the unchanged-name set keeps 101 and loses 100
    assert ("renamed", 101, "Added", 107) in got and ("renamed", 101, "Added", 207) in got
    assert ("a", 100, "Removed", 107) in got and ("a", 100, "Removed", 207) in got


def test_person_flags_with_and_without_broadcast(spark):
    diff = df(spark, [(7, 100, "same"), (7, 101, "added"), (8, 100, "removed")],
              "cohort_definition_id bigint, concept_id bigint, concept_type string")
    events = df(spark, [(1, 100), (1, 100), (1, 101), (2, 100), (None, 101)], "person_id bigint, source_concept_id bigint")
    a = rows(S.person_flags(events, diff, small=True))
    b = rows(S.person_flags(events, diff, small=False))
    assert a == b
    assert (7, 1, 1, 1, 0) in a


def test_source_vocabularies_none_means_all_and_empty_is_an_error(spark):
    old, new = _two_set_vocabs(spark)
    items = df(spark, [(1, 0, 0, 1, "a", 7, "c")], ITEMS)
    counts = df(spark, [(100, 5, 5)], COUNTS)
    assert vocabulary_change_report(items, old, new, counts, included_source_vocabs=None)["mapping_diff"].count() == 1
    for wrong in ([], 0, "ICD10CM"):
        with pytest.raises(ValueError, match="included_source_vocabs"):
            vocabulary_change_report(items, old, new, counts, included_source_vocabs=wrong)
    with pytest.raises(ValueError, match="unknown reports"):
        vocabulary_change_report(items, old, new, counts, reports=["cohort_stats"])


def test_duplicate_count_rows_repeat_old_targets(spark):
    concepts = [_std(1), _std(2), _src(100)]
    old = vocab(spark, concepts, [(1, 1), (2, 2)], maps(100, 1))
    new = vocab(spark, concepts, [(1, 1), (2, 2)], maps(100, 2))
    items = df(spark, [(1, 0, 0, 1, "a", 7, "c")], ITEMS)
    counts = df(spark, [(100, 5, 5), (100, 5, 9)], COUNTS)
    got = vocabulary_change_report(items, old, new, counts)["mapping_diff"].collect()
    assert [(r.old_mapped_concept_id, r.new_mapped_concept_id) for r in got] == [("1-1", "2")]
