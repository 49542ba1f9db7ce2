"""Words of sets and the difference from what changed: equal to the full forms, and built from less."""

import pytest
from helpers import ITEMS, df, maps, rows, vocab
from test_random_vs_sql import _ddl, _draw

from vocabshift import vocabulary_change_report
from vocabshift.model import PAIR_SET_KEYS, SET_KEYS, Vocabulary
from vocabshift.operators import delta as DELTA
from vocabshift.operators import diff as D
from vocabshift.operators import resolve as R
from vocabshift.sources.fixtures import EXCLUDED_NODES


def _words(items, old, new, excluded=()):
    held = DELTA.numbered(items)
    return DELTA.concept_sides(*[DELTA.resolve_words(held, v, excluded) for v in (old, new)])


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_equal_to_the_full_forms_on_random_inputs(spark, seed):
    frames = {
        name: spark.createDataFrame(data, ", ".join(f"{c} {_ddl(t)}" for c, t in cols)) for name, (data, cols) in _draw(seed).items()
    }
    old, new = (Vocabulary(*[frames[f"fx_{t}_{v}"] for t in ("concept", "ancestor", "rel")]) for v in ("old", "new"))
    items = frames["fx_items"]
    for keys in (SET_KEYS, PAIR_SET_KEYS):
        sides = []
        for v in (old, new):
            want = R.resolve_concepts_two_pass(items, v, EXCLUDED_NODES, keys)
            assert rows(DELTA.resolve_concepts_by_words(items, v, EXCLUDED_NODES, keys)) == rows(want)
            sides.append(D.source_concepts(want, v, keys))
        want = rows(D.source_concept_diff_two_pass(*sides, keys))
        assert want and rows(DELTA.source_concept_diff_by_delta(items, old, new, EXCLUDED_NODES, keys)) == want


def _hot(spark, changed):
    """150 sets that hold concept 21, which 400 codes map to; sets 0 and 1 also gain or lose concepts with codes."""
    concepts = [(c, f"n{c}", "Condition", "SNOMED", "S", f"c{c}") for c in (21, 22, 23)]
    tree = [(c, c) for c in (21, 22, 23)]
    edges = [e for code in range(1000, 1400) for e in maps(code, 21)] + [e for c in (2000, 2001) for e in maps(c, 22)]
    edges += maps(1000, 22) + [(21, None, "Mapped from", None)]
    old = vocab(spark, concepts, tree, edges)
    new = vocab(spark, concepts, [(21, 21), (22, 22), *([(22, 23)] if changed else [(23, 23)])], edges + (maps(3000, 23) if changed else []))
    items = [(21, 0, 1, s, f"s{s}", s // 10, None) for s in range(150)] + [(22, 0, 1, 0, "s0", 0, None), (21, 1, 0, 1, "s1", 0, None)]
    return df(spark, items, ITEMS), old, new


def test_untouched_concepts_meet_no_edge(spark):
    items, old, new = _hot(spark, changed=False)
    concepts, edges = _words(items, old, new), DELTA.edge_sides(old, new)
    assert DELTA.candidates(concepts, edges).count() == 0
    assert DELTA.source_concept_diff_by_delta(items, old, new).count() == 0
    words = DELTA.resolve_words(DELTA.numbered(items), old).where("descendant_concept_id = 21").collect()
    assert len(words) <= DELTA.GROUPS and sum(bin(w.bits & (2**64 - 1)).count("1") for w in words) == 149

    items, old, new = _hot(spark, changed=True)
    concepts, edges = _words(items, old, new), DELTA.edge_sides(old, new)
    places = DELTA.candidates(concepts, edges).collect()
    assert {r.code for r in places} == {3000} and len(places) == 1  # none of the 400 codes of concept 21
    got = rows(DELTA.source_concept_diff_by_delta(items, old, new))
    assert got == [(0, None, "s0", 0, 3000, "Added")]


def test_a_hot_concept_that_leaves_all_sets_costs_words_times_codes(spark):
    items, old, _ = _hot(spark, changed=False)
    gone = Vocabulary(old.concept.where("concept_id <> 21"), old.ancestor, old.relationship)
    concepts, edges = _words(items, old, gone), DELTA.edge_sides(old, gone)
    codes = 401  # a null code is a code
    assert DELTA.candidates(concepts, edges).count() <= codes * DELTA.GROUPS
    got = rows(DELTA.source_concept_diff_by_delta(items, old, gone))
    want = [D.source_concepts(R.resolve_concepts(items, v), v) for v in (old, gone)]
    assert got == rows(D.source_concept_diff(*want)) and len(got) == 149 * codes - 1  # set 0 keeps code 1000 by concept 22


def test_words_of_more_sets_than_bits(spark):
    items = [(21, 0, 1, s, None, s % 7, None) for s in range(3000)] + [(21, 1, 1, s, None, s % 7, None) for s in range(0, 3000, 3)]
    items = df(spark, items * 2, ITEMS)
    old = vocab(spark, [(21, "a", "d", "v", "S", "c")], [(21, 21), (21, 22)])
    held = DELTA.numbered(items)
    assert DELTA.sets_of(held).select("_word", "_bit").distinct().count() == 3000
    assert rows(DELTA.resolve_concepts_by_words(items, old)) == rows(R.resolve_concepts_two_pass(items, old))
    empty = items.limit(0)
    assert DELTA.resolve_concepts_by_words(empty, old).count() == 0
    assert DELTA.source_concept_diff_by_delta(empty, old, old).count() == 0


def test_only_known_differences(spark):
    items, old, new = _hot(spark, changed=False)
    with pytest.raises(ValueError):
        vocabulary_change_report(items, old, new, None, difference="part")
