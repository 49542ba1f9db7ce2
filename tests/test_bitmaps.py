"""Cohorts as bitmaps: against plain sets, with very many cohorts on a code, and odd ids."""

import random

import pytest

from helpers import df
from vocabshift.operators import stats as S

DIFF = "cohort_definition_id bigint, concept_id bigint, concept_type string"
EVENTS = "person_id bigint, source_concept_id bigint"
FLAG = {"same": 0, "added": 1, "removed": 2}


def flags_of(events, diff):
    found = {}
    for person, code in events:
        for cohort, c, kind in diff:
            if code is not None and code == c:
                found.setdefault((cohort, person), [0, 0, 0])[FLAG[kind]] = 1
    return {(*k, *v) for k, v in found.items()}


@pytest.mark.parametrize("small", [True, False])
def test_random_cohorts_equal_plain_sets(spark, small):
    rng = random.Random(4)
    cohorts = [None, -1, -64, -65, 0, 1, 63, 64, 65, 127, 128, 10**12]
    diff = [(c, code, rng.choice(list(FLAG))) for code in [*range(20), None] for c in rng.sample(cohorts, rng.randint(0, 12))]
    events = [(rng.choice([None, *range(8)]), rng.choice([None, *range(25)])) for _ in range(300)]
    d, e = df(spark, diff, DIFF), df(spark, events, EVENTS)
    got = S.person_flags(e, d, small).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == flags_of(events, diff)
    matched = sorted(map(tuple, S.matched_events(e, d, small).collect()), key=repr)
    assert matched == sorted(((c, p, kind) for p, code in events for c, k, kind in diff if code is not None and k == code), key=repr)


@pytest.mark.parametrize("small", [True, False])
def test_a_hundred_thousand_cohorts_on_one_code(spark, small):
    from pyspark.sql import functions as F

    kinds = F.element_at(F.array(*map(F.lit, FLAG)), (F.col("id") % 3 + 1).cast("int"))
    diff = spark.range(100_000).select(F.col("id").alias("cohort_definition_id"), F.lit(7).cast("bigint").alias("concept_id"), kinds.alias("concept_type"))
    words = S.cohort_words(diff)
    assert words.count() == -(-100_000 // S.WORD)  # fixed-width rows, none of which grows with the cohorts
    assert {t for _, t in words.dtypes} == {"bigint"}
    events = spark.range(30).select((F.col("id") % 3).alias("person_id"), F.lit(7).cast("bigint").alias("source_concept_id"))
    flags = S.person_flags(events, diff, small)
    got = flags.agg(F.count("*"), *[F.sum(c) for c in S.KINDS.values()], F.countDistinct("cohort_definition_id")).first()
    assert tuple(got) == (300_000, 100_002, 99_999, 99_999, 100_000)
    wrong = flags.where("has_same + has_new + has_old <> 1 or has_same <> int(cohort_definition_id % 3 = 0)").count()
    assert wrong == 0


def test_empty_sides(spark):
    none, some = df(spark, [], DIFF), df(spark, [(1, 2, "same")], DIFF)
    assert S.person_flags(df(spark, [(1, 2)], EVENTS), none).collect() == []
    assert S.person_flags(df(spark, [], EVENTS), some).collect() == []
