"""Places by ranges equal row numbers, and staged tables go with their owner."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vocabshift.operators.rank import ranked
from vocabshift.staging import Staging


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables would be coalesced to one range."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def rows(spark, n=3_000, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 1, 2, None, 7]), rng.choice([None, *range(40)]), i) for i in range(n)]
    return spark.createDataFrame(data, "g long, v int, i long").repartition(7)


def test_places_in_groups_that_cross_ranges(spark):
    with Staging(spark) as stage:
        df = rows(spark)
        got = ranked(df, [F.col("v").asc_nulls_first(), "i"], stage, group=["g"])
        want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first(), "i")))
        assert sorted(got.collect(), key=repr) == sorted(want.select(*got.columns).collect(), key=repr)
        ranges = spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).where("g = 1").select("_range").distinct().count()
        assert ranges > 1  # the hot group is no single task


def test_places_in_the_whole_table(spark):
    with Staging(spark) as stage:
        got = ranked(rows(spark), [F.col("v").desc(), "i"], stage, name="at", keep=("i",)).orderBy("at").collect()
        want = rows(spark).orderBy(F.col("v").desc(), "i").collect()
        assert [(r["i"], r["at"]) for r in got] == [(r["i"], k + 1) for k, r in enumerate(want)]


def test_equal_rows_get_different_places(spark):
    with Staging(spark) as stage:
        df = spark.createDataFrame([(1, 5)] * 200 + [(1, 4)], "g long, v int")
        assert sorted(r["place"] for r in ranked(df, ["v"], stage, group=["g"]).collect()) == list(range(1, 202))


def test_empty_table(spark):
    with Staging(spark) as stage:
        empty = spark.createDataFrame([], "g long, v int")
        assert ranked(empty, ["v"], stage).collect() == [] and ranked(empty, ["v"], stage, group=["g"]).collect() == []


def test_staged_tables_are_removed(spark):
    stage = Staging(spark, "t")
    one, two = stage.put(spark.range(5).toDF("a"), "one"), stage.put(spark.range(3).toDF("a"), "two")
    assert (one.count(), two.count()) == (5, 3)
    paths = [p.removeprefix("file:") for p in stage.paths]
    stage.drop(one)
    assert [os.path.exists(p) for p in paths] == [False, True]
    stage.close()
    assert not os.path.exists(paths[1]) and not stage.paths
