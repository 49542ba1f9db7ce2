"""Test inputs derived from the driver's TPC-H-ish tables.

This is fixture generation, not engine code: it turns ``part``, ``orders``
and ``lineitem`` into the inputs the analysis reads (two vocabulary
versions, concept-set items, a cohort map, record counts and six event
tables), with planted changes between the versions.  The rules follow the
fixture definition in FIXTURES.md §3; the DuckDB oracle builds the same
views in SQL, so every value here is cross-checked.

Everything is one lazy DataFrame plan over the Parquet scans: the data
grows with the driver tables, nothing is collected or made up locally.
A few MB of files hold millions of rows, and more once they are expanded, so
the rows of ``part`` are dealt over the tasks first (``_dealt``), and the
planner, which goes by the bytes of the files, is told not to broadcast the
tables (``_large``).  A side that the operators broadcast for its bound still is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import (
    ANCESTOR_SCHEMA,
    CONCEPT_SCHEMA,
    COUNT_SCHEMA,
    MAPPED_FROM,
    MAPS_TO,
    MAPS_TO_VALUE,
    RELATIONSHIP_SCHEMA,
    Vocabulary,
)
from ..staging import Staging

# Fixed fixture parameters (FIXTURES.md §3).
EXCLUDED_NODES = (36, 39)
INCLUDED_SOURCE_VOCABS = ("ICD10CM", "ICD9CM", "CPT4", "NDC", "HCPCS")
# Event table names and their source-concept column, in fixture order (tbl 0..5).
EVENT_TABLES = (
    ("condition_occurrence", "condition_source_concept_id"),
    ("procedure_occurrence", "procedure_source_concept_id"),
    ("drug_exposure", "drug_source_concept_id"),
    ("device_exposure", "device_source_concept_id"),
    ("measurement", "measurement_source_concept_id"),
    ("observation", "observation_source_concept_id"),
)
# The vocabulary version whose cohort pairs the pair reports use.
PAIR_VERSION = "v0"
# A standard concept c has id 3c and its two source codes 3c + 1 and 3c + 2, so ids never meet at any size.
IDS_PER_CONCEPT = 3
# Planted skew: a concept that most sets hold and that a fifth of the codes map to, and the code of a third of all events.
HOT_CONCEPT = 7
HOT_EVENT_CODE = 31


def _div(c: Column, f: int) -> Column:
    """``CAST(floor(c / f) AS BIGINT)``."""
    return F.floor(c / F.lit(f)).cast("bigint")


def _id(c: Column) -> Column:
    """Id of the standard concept ``c``."""
    return (c * F.lit(IDS_PER_CONCEPT)).cast("bigint")


def _levels(c: Column) -> Column:
    """0, 1, ... as long as ``c >> 2 * level`` is at least 1 (the depth of ``c`` in the 4-ary tree)."""
    return F.sequence(F.lit(0), F.floor((F.length(F.bin(c)) - 1) / 2).cast("int"))


def _str(c: Column) -> Column:
    return c.cast("string")


def _standard_domain(c: Column) -> Column:
    m = c % 5
    return (
        F.when(m == 0, "Condition")
        .when(m == 1, "Procedure")
        .when(m == 2, "Drug")
        .when(m == 3, "Measurement")
        .otherwise("Observation")
    )


def _source_vocabulary(c: Column) -> Column:
    m = c % 6
    return (
        F.when(m == 0, "ICD10CM")
        .when(m == 1, "ICD9CM")
        .when(m == 2, "CPT4")
        .when(m == 3, "NDC")
        .when(m == 4, "HCPCS")
        .otherwise("LOCAL")
    )


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """``df`` dealt evenly over the tasks: the scan of a small file is one task, whatever its rows become later."""
    return df.hint("rebalance", F.col(by))


def _large(df: DataFrame) -> DataFrame:
    """``df``, which no join broadcasts for the size of the files it comes from."""
    return df.hint("merge")


@dataclass
class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor directory."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- concepts -----------------------------------------------------------
    @cached_property
    def c(self) -> DataFrame:
        return _dealt(self.table("part").select((F.col("p_partkey") + 1).cast("bigint").alias("c"), "p_name"), "c")

    @cached_property
    def src(self) -> DataFrame:
        # Two source codes per standard concept, j = 1, 2.
        return self.c.select(
            "c", F.explode(F.array(F.lit(1), F.lit(2))).alias("j"), "p_name"
        ).select("c", "j", (_id(F.col("c")) + F.col("j")).alias("s"), "p_name")

    @cached_property
    def concept_old(self) -> DataFrame:
        c = F.col("c")
        standard = self.c.select(
            _id(c).alias("concept_id"),
            F.col("p_name").alias("concept_name"),
            _standard_domain(c).alias("domain_id"),
            F.lit("STD").alias("vocabulary_id"),
            F.when(c % 23 == 0, F.lit(None).cast("string"))
            .when(c % 29 == 0, "C")
            .otherwise("S")
            .alias("standard_concept"),
            F.concat(F.lit("S"), _str(c)).alias("concept_code"),
        )
        source = self.src.select(
            F.col("s").alias("concept_id"),
            F.concat("p_name", F.lit(" source")).alias("concept_name"),
            F.lit("Observation").alias("domain_id"),
            _source_vocabulary(c).alias("vocabulary_id"),
            F.lit(None).cast("string").alias("standard_concept"),
            F.concat(F.lit("X"), _str(F.col("s"))).alias("concept_code"),
        )
        return standard.unionByName(source)

    @cached_property
    def concept_new(self) -> DataFrame:
        cid = F.col("concept_id")
        std = cid % IDS_PER_CONCEPT == 0
        second = cid % IDS_PER_CONCEPT == 2
        c = _div(cid, IDS_PER_CONCEPT)
        return self.concept_old.where(~(std & (c % 97 == 0)) & ~(second & (c % 101 == 0))).select(
            "concept_id",
            "concept_name",
            F.when(std & (c % 17 == 0), "Device").otherwise(F.col("domain_id")).alias("domain_id"),
            "vocabulary_id",
            F.when(std & (c % 19 == 0), F.lit(None).cast("string"))
            .otherwise(F.col("standard_concept"))
            .alias("standard_concept"),
            "concept_code",
        )

    # -- hierarchy ----------------------------------------------------------
    @cached_property
    def tree(self) -> DataFrame:
        """Every concept with itself and all its ancestors in the 4-ary tree, up to the root."""
        levels = self.c.select("c", F.explode(_levels(F.col("c"))).alias("k"))
        return levels.select("c", F.expr("shiftright(c, 2 * k)").alias("a"))

    @staticmethod
    def _closure(tree: DataFrame) -> DataFrame:
        return tree.select(_id(F.col("a")).alias("ancestor_concept_id"), _id(F.col("c")).alias("descendant_concept_id"))

    @cached_property
    def ancestor_old(self) -> DataFrame:
        return self._closure(self.tree.where("c % 23 <> 0 AND a % 23 <> 0"))

    @cached_property
    def ancestor_new(self) -> DataFrame:
        kept = self.tree.where("c % 23 <> 0 AND a % 23 <> 0 AND a % 19 <> 0 AND c % 19 <> 0 AND a % 97 <> 0 AND c % 97 <> 0")
        return self._closure(kept.where("c % 31 <> 0 OR a = c"))

    # -- mappings -----------------------------------------------------------
    @staticmethod
    def _edges(frame: DataFrame, source: Column, target: Column, invalid: Column | None = None) -> DataFrame:
        reason = F.lit(None).cast("string") if invalid is None else F.when(invalid, "D")
        return frame.select(source.alias("source_id"), target.alias("target_id"), reason.alias("invalid_reason"))

    @cached_property
    def mapsto_old(self) -> DataFrame:
        c, j, s = F.col("c"), F.col("j"), F.col("s")
        parts = (
            self._edges(self.src.where(c % 43 != 0), s, _id(c), c % 41 == 0),
            self._edges(self.src.where((c % 13 == 0) & (j == 1)), s, _id(_div(c, 2))),
            self._edges(self.src.where((c % 5 == 1) & (j == 2)), s, _id(F.lit(HOT_CONCEPT))),
            self._edges(self.c.where(c % 23 != 0), _id(c), _id(c)),
        )
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def mapsto_new(self) -> DataFrame:
        c, j, s = F.col("c"), F.col("j"), F.col("s")
        moved = F.when(c % 19 == 0, _id(_div(c, 4)))
        parts = (
            self._edges(self.src, s, moved.when((c % 7 == 0) & (j == 1), _id(c + 1)).otherwise(_id(c)), c % 47 == 0),
            self._edges(self.src.where((c % 26 == 0) & (j == 1)), s, _id(_div(c, 2))),
            self._edges(self.src.where((c % 10 == 1) & (j == 2)), s, _id(F.lit(HOT_CONCEPT))),
            self._edges(self.c.where(c % 23 != 0), _id(c), moved.otherwise(_id(c))),
        )
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _relationship(mapsto: DataFrame) -> DataFrame:
        fwd = mapsto.select(
            F.col("source_id").alias("concept_id_1"),
            F.col("target_id").alias("concept_id_2"),
            F.lit(MAPS_TO).alias("relationship_id"),
            "invalid_reason",
        )
        back = mapsto.select(
            F.col("target_id").alias("concept_id_1"),
            F.col("source_id").alias("concept_id_2"),
            F.lit(MAPPED_FROM).alias("relationship_id"),
            "invalid_reason",
        )
        return fwd.unionByName(back)

    @cached_property
    def relationship_old(self) -> DataFrame:
        return self._relationship(self.mapsto_old)

    @cached_property
    def relationship_new(self) -> DataFrame:
        c = F.col("c")
        value = self.c.where(c % 38 == 0).select(
            _id(c).alias("concept_id_1"),
            _id(_div(c, 2)).alias("concept_id_2"),
            F.lit(MAPS_TO_VALUE).alias("relationship_id"),
            F.lit(None).cast("string").alias("invalid_reason"),
        )
        return self._relationship(self.mapsto_new).unionByName(value)

    @cached_property
    def old(self) -> Vocabulary:
        return Vocabulary(_large(self.concept_old), _large(self.ancestor_old), _large(self.relationship_old))

    @cached_property
    def new(self) -> Vocabulary:
        return Vocabulary(_large(self.concept_new), _large(self.ancestor_new), _large(self.relationship_new))

    # -- concept sets and cohorts --------------------------------------------
    @cached_property
    def items(self) -> DataFrame:
        c = F.col("c")
        set_id = _div(c, 8) % 2

        def rows(frame: DataFrame, concept: Column, excluded: Column, descendants: Column, cohort: Column) -> DataFrame:
            return frame.select(
                concept.alias("conceptid"),
                excluded.alias("isexcluded"),
                descendants.alias("includedescendants"),
                set_id.alias("conceptsetid"),
                F.concat(F.lit("set "), _str(set_id)).alias("conceptsetname"),
                cohort.alias("cohortid"),
                F.concat(F.lit("cohort "), _str(cohort)).alias("cohortname"),
            )

        cohort = F.lit(1) + c % 8
        every = rows(
            self.c,
            _id(c),
            F.when(c % 5 == 0, 1).otherwise(0),
            F.when((c <= 64) | (c % 3 == 0), 1).otherwise(0),
            F.when(c % 3 == 0, F.lit(1).cast("bigint")).otherwise(cohort),
        )
        # the hot concept once more, in 14 of the 16 sets
        hot = rows(self.c.where(c.between(8, 21)), _id(F.lit(HOT_CONCEPT)), F.lit(0), F.lit(1), cohort)
        return _large(every.unionByName(hot))

    @cached_property
    def items_updated(self) -> DataFrame:
        c = _div(F.col("conceptid"), IDS_PER_CONCEPT)
        return self.items.where(c % 37 != 0).select(
            F.when(c % 19 == 0, _id(_div(c, 4))).otherwise(F.col("conceptid")).alias("conceptid"),
            "isexcluded",
            "includedescendants",
            "conceptsetid",
            "conceptsetname",
            (F.col("cohortid") + 100).alias("cohortid"),
            "cohortname",
        )

    @cached_property
    def cohort_pairs(self) -> DataFrame:
        """The pair table with two vocabulary versions."""
        cohorts = self.items.select("cohortid").distinct()

        def pairs(frame: DataFrame, shift: int, version: str) -> DataFrame:
            return frame.select(
                F.col("cohortid").alias("old_cohort_id"),
                (F.col("cohortid") + shift).alias("new_cohort_id"),
                F.lit(version).alias("old_cohort_vocab_version"),
            )

        return pairs(cohorts, 100, PAIR_VERSION).unionByName(pairs(cohorts.where("cohortid % 2 = 0"), 101, "v1"))

    @cached_property
    def cohort_map(self) -> DataFrame:
        return self.cohort_pairs.where(F.col("old_cohort_vocab_version") == PAIR_VERSION)

    @cached_property
    def cohort_names(self) -> DataFrame:
        return self.items.where(F.col("cohortid") != 8).select("cohortid", "cohortname").distinct()

    # -- events and counts ---------------------------------------------------
    @cached_property
    def event(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        od = _large(self.table("orders").select("o_orderkey", "o_custkey"))
        own = _id(F.col("l_partkey") + 1) + 1 + F.col("l_linenumber") % 2
        code = F.when(F.col("l_orderkey") % 3 == 0, F.lit(HOT_EVENT_CODE).cast("bigint")).otherwise(own)
        return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("person_id"),
            code.alias("source_concept_id"),
            (_div(code, IDS_PER_CONCEPT) % 6).alias("tbl"),
        )

    def hold_events(self, staging: Staging) -> None:
        """The joined events written once, for a reader of several tables that are made of them."""
        self.event = staging.put(self.event, "event")

    @cached_property
    def event_tables(self) -> dict[str, DataFrame]:
        """The six clinical event tables, each with its own column name."""
        return {
            name: self.event.where(F.col("tbl") == k).select(
                "person_id", F.col("source_concept_id").alias(column)
            )
            for k, (name, column) in enumerate(EVENT_TABLES)
        }

    @cached_property
    def record_count(self) -> DataFrame:
        return self.event.groupBy(F.col("source_concept_id").alias("concept_id")).agg(
            F.count(F.lit(1)).alias("record_count")
        )

    @cached_property
    def concept_count(self) -> DataFrame:
        direct = self.record_count.select(
            "concept_id", "record_count", F.col("record_count").alias("descendant_record_count")
        )
        valid = _large(self.mapsto_old.where(F.col("invalid_reason").isNull()))
        rolled = (
            _large(self.ancestor_old).join(valid, F.col("target_id") == F.col("descendant_concept_id"))
            .join(_large(self.record_count), F.col("concept_id") == F.col("source_id"))
            .groupBy(F.col("ancestor_concept_id").alias("concept_id"))
            .agg(
                F.lit(0).cast("bigint").alias("record_count"),
                F.sum("record_count").cast("bigint").alias("descendant_record_count"),
            )
        )
        return _large(direct.unionByName(rolled))


# -- fixture inputs as tables ----------------------------------------------------
INPUT_MARKER = "_vocabshift_inputs"
INPUT_TABLES = (
    "concept_old",
    "concept_new",
    "ancestor_old",
    "ancestor_new",
    "relationship_old",
    "relationship_new",
    "items",
    "items_updated",
    "cohort_pairs",
    "cohort_names",
    "concept_count",
)


_ITEMS_DDL = (
    "conceptid bigint, isexcluded int, includedescendants int, conceptsetid bigint, "
    "conceptsetname string, cohortid bigint, cohortname string"
)
INPUT_SCHEMAS = {
    "concept_old": CONCEPT_SCHEMA,
    "concept_new": CONCEPT_SCHEMA,
    "ancestor_old": ANCESTOR_SCHEMA,
    "ancestor_new": ANCESTOR_SCHEMA,
    "relationship_old": RELATIONSHIP_SCHEMA,
    "relationship_new": RELATIONSHIP_SCHEMA,
    "items": _ITEMS_DDL,
    "items_updated": _ITEMS_DDL,
    "cohort_pairs": "old_cohort_id bigint, new_cohort_id bigint, old_cohort_vocab_version string",
    "cohort_names": "cohortid bigint, cohortname string",
    "concept_count": COUNT_SCHEMA,
    **{name: f"person_id bigint, {column} bigint" for name, column in EVENT_TABLES},
}


def write_inputs(fx: Fixtures, path: str) -> str:
    """Write the fixture inputs as Parquet tables under ``path`` (one folder each).

    Real inputs arrive as tables; benchmarks read these so that timings
    cover the analysis, not the fixture derivation.
    """
    for name in INPUT_TABLES:
        getattr(fx, name).write.mode("overwrite").parquet(f"{path}/{name}")
    for name, df in fx.event_tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    fx.spark.createDataFrame([(1,)], "v int").write.mode("overwrite").parquet(f"{path}/{INPUT_MARKER}")
    return path


@dataclass
class TableInputs:
    """The same inputs as :class:`Fixtures`, read from written tables."""

    spark: SparkSession
    path: str

    def _t(self, name: str) -> DataFrame:
        cache = self.__dict__.setdefault("_tables", {})
        if name not in cache:
            # Declared schemas: no footer-inference job per table.
            cache[name] = self.spark.read.schema(INPUT_SCHEMAS[name]).parquet(f"{self.path}/{name}")
        return cache[name]

    def __getattr__(self, name: str):
        if name in INPUT_TABLES and not name.startswith("_"):
            return self._t(name)
        raise AttributeError(name)

    @property
    def cohort_map(self) -> DataFrame:
        return self._t("cohort_pairs").where(F.col("old_cohort_vocab_version") == PAIR_VERSION)

    @property
    def old(self) -> Vocabulary:
        return Vocabulary(self._t("concept_old"), self._t("ancestor_old"), self._t("relationship_old"))

    @property
    def new(self) -> Vocabulary:
        return Vocabulary(self._t("concept_new"), self._t("ancestor_new"), self._t("relationship_new"))

    @property
    def event_tables(self) -> dict[str, DataFrame]:
        return {name: self._t(name) for name, _ in EVENT_TABLES}


def _has_marker(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds written inputs (works on any Hadoop file system)."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema("v int").parquet(f"{path}/{INPUT_MARKER}")
        return True
    except AnalysisException:
        return False


def inputs_for(spark: SparkSession, path: str):
    """Written inputs when ``path`` holds them, else fixtures derived from the driver tables there."""
    if not _has_marker(spark, path):
        return Fixtures(spark, path)
    return TableInputs(spark, path)
