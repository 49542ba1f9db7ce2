"""The fixture rules hold at sizes that the test tables do not reach."""

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conftest import SMALL_SF
from vocabshift.sources.fixtures import HOT_CONCEPT, HOT_EVENT_CODE, Fixtures

# pieces of the range 1 to 4 billion, where ids of different kinds might meet
PIECES = ((1, 3_000), (331_000, 336_000), (998_000, 1_003_000), (1_998_000, 2_003_000), (4_000_000_000, 4_000_003_000))


class Large(Fixtures):
    @cached_property
    def c(self) -> DataFrame:
        pieces = [self.spark.range(a, b) for a, b in PIECES]
        return reduce(DataFrame.union, pieces).select(F.col("id").alias("c"), F.lit("x").alias("p_name"))


def test_ids_never_meet_and_every_concept_reaches_the_root(spark):
    fx = Large(spark, SMALL_SF)
    n = fx.c.count()
    ids = fx.concept_old.select("concept_id")
    assert ids.count() == ids.distinct().count() == 3 * n
    standard = fx.concept_old.where("vocabulary_id = 'STD'")
    assert standard.where("concept_id % 3 <> 0").count() == 0
    tree = fx.tree.groupBy("c").agg(F.count("*").alias("levels"), F.min("a").alias("top"), F.max("a").alias("own"))
    wrong = tree.where("top not between 1 and 3 or own <> c or levels <> floor((length(bin(c)) + 1) / 2)")
    assert wrong.count() == 0 and tree.count() == n


def test_skew_is_planted(spark):
    fx = Fixtures(spark, SMALL_SF)
    events = fx.event
    share = events.where(F.col("source_concept_id") == HOT_EVENT_CODE).count() / events.count()
    assert 0.25 < share < 0.45
    sources = fx.mapsto_old.where(F.col("target_id") == 3 * HOT_CONCEPT).count()
    assert sources > fx.c.count() / 6
    sets = fx.items.where(F.col("conceptid") == 3 * HOT_CONCEPT).select("cohortid", "conceptsetid").distinct().count()
    assert sets >= 14
    assert {r[0] for r in fx.cohort_pairs.select("old_cohort_vocab_version").distinct().collect()} == {"v0", "v1"}


def test_derived_tables_are_not_broadcast_for_the_size_of_their_files(spark):
    """A few MB of ``part`` expand to millions of rows; what the planner takes for small must not go through the driver."""
    from vocabshift.operators import mapping as M
    from vocabshift.operators.resolve import resolve_concepts
    from vocabshift.plans.broadcast import CONF_KEY

    fx = Fixtures(spark, SMALL_SF)
    before = spark.conf.get(CONF_KEY, None)
    spark.conf.set(CONF_KEY, "0")  # no side is small by its bound either
    try:
        resolved = resolve_concepts(fx.items, fx.old)
        codes = resolved.select(F.col("descendant_concept_id").alias("source_concept_id"))
        for made in (fx.concept_count, resolved, M.with_targets(codes, fx.new), fx.event):
            assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(CONF_KEY) if before is None else spark.conf.set(CONF_KEY, before)


def test_rows_of_a_small_file_are_dealt_over_the_tasks(spark):
    fx = Fixtures(spark, SMALL_SF)
    for made in (fx.c, fx.ancestor_old, fx.items):
        assert "REBALANCE_PARTITIONS_BY_COL" in made._jdf.queryExecution().executedPlan().toString()


def test_known_bytes_of_repeated_names_cover_their_rows(spark, tmp_path):
    from vocabshift.plans.broadcast import known_bytes

    name = "a concept set with a longer name"
    rows = spark.range(200_000).select("id", F.lit(1).alias("flag"), F.lit(name).alias("name"), F.concat(F.lit(name), F.lit("s")).alias("cohort"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/items")
    assert known_bytes(spark.read.parquet(f"{tmp_path}/items")) >= 200_000 * (8 + 4 + 2 * len(name))


def test_expanded_rows_are_dealt_before_a_hash_table_holds_them(spark):
    """A node with many descendants or codes is expanded by one task, which must not also hold all of its groups."""
    from vocabshift.operators import diff as D
    from vocabshift.operators.resolve import resolve_concepts

    fx = Fixtures(spark, SMALL_SF)
    sides = [resolve_concepts(fx.items, v) for v in (fx.old, fx.new)]
    for made in (sides[0], D.source_concept_diff(*[D.source_concepts(s, v) for s, v in zip(sides, (fx.old, fx.new), strict=True)])):
        lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
        first = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
        assert "REPARTITION_BY_COL" in lines[first] and sum("HashAggregate" in x for x in lines[:first]) == 2


def test_held_events_are_joined_once(spark):
    from vocabshift.staging import Staging

    with Staging(spark, "events") as stage:
        fx, plain = Fixtures(spark, SMALL_SF), Fixtures(spark, SMALL_SF)
        fx.hold_events(stage)
        assert len(stage.paths) == 1
        for made, same in ((fx.event_tables["measurement"], plain.event_tables["measurement"]), (fx.concept_count, plain.concept_count)):
            assert "l_orderkey" not in made._jdf.queryExecution().executedPlan().toString()
            assert sorted(made.collect()) == sorted(same.collect())
