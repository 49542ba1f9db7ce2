"""Cohort-definition JSON sources and the report sink."""

import json
import os
import uuid

from helpers import ITEMS, df, rows

from vocabshift.session import checkpoint_dir
from vocabshift.sinks.reports import read_report, write_reports
from vocabshift.sources import documents as DOCUMENTS
from vocabshift.sources import items as I
from vocabshift.sources import tables as T


def _scratch(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


DOCS = [
    {
        "id": 1, "name": "one", "createdDate": "2023-01-01",
        "expression": {"ConceptSets": [
            {"id": 0, "name": "set a", "expression": {"items": [
                {"concept": {"CONCEPT_ID": 10}, "isExcluded": False, "includeDescendants": True},
                {"concept": {"CONCEPT_ID": 11}, "isExcluded": True},
            ]}},
            {"id": 1, "name": "empty", "expression": {"items": []}},
        ]},
    },
    {"id": 2, "name": "no sets", "createdDate": "2023-01-02", "expression": {"ConceptSets": []}},
]


def test_read_definitions_from_files(spark):
    path = _scratch(spark)
    os.makedirs(_local(path))
    for d in DOCS:
        with open(os.path.join(_local(path), f"{d['id']}.json"), "w") as fh:
            json.dump(d, fh, indent=2)
    with open(os.path.join(_local(path), "bad.json"), "w") as fh:
        fh.write("{not json")
    defs = I.read_cohort_definitions(spark, path)
    got = rows(I.concept_set_items(defs))
    assert got == [
        (10, 0, 1, 0, "set a", 1, "one", "2023-01-01"),
        (11, 1, 0, 0, "set a", 1, "one", "2023-01-01"),
    ]
    requested = spark.createDataFrame([(1,), (2,), (3,)], "cohortid bigint")
    assert rows(I.missing_cohorts(requested, defs)) == [(3,)]
    only = lambda i: spark.createDataFrame([(i,), (99,)], "cohortid bigint")
    assert rows(I.concept_set_items(defs, only(2))) == []
    assert rows(I.concept_set_items(defs, only(1))) == got


def test_definition_round_trip(spark):
    items = df(spark, [(10, 0, 1, 0, "a", 1, "one"), (11, 1, 0, 0, "a", 1, "one"), (12, 0, 0, 5, "b", 2, "two")], ITEMS)
    back = I.concept_set_items(I.parse_cohort_definitions(DOCUMENTS.to_cohort_definitions(items)))
    assert rows(back.drop("createddate")) == rows(items)
    lib = DOCUMENTS.to_library_concept_sets(items)
    log = spark.createDataFrame([(1, "one", "2024-01-01")], "cohortId bigint, cohortName string, createdDate string")
    got = rows(I.library_items(lib, log))
    assert got == [(10, 0, 1, 0, "a", 1, "one", "2024-01-01"), (11, 1, 0, 0, "a", 1, "one", "2024-01-01")]


def test_write_reports_parquet_and_csv(spark):
    rep = {"stats": df(spark, [(1, "x", 3), (2, None, 5)], "cohort_definition_id bigint, cohortname string, total_persons bigint")}
    base = _scratch(spark)
    paths = write_reports(rep, base, project="p_")
    assert rows(read_report(spark, paths["stats"])) == rows(rep["stats"])
    paths = write_reports(rep, base + "-csv", fmt="csv", camel_case=True)
    back = read_report(spark, paths["stats"], fmt="csv")
    assert back.columns == ["cohortDefinitionId", "cohortname", "totalPersons"]
    assert back.count() == 2


def test_documents_are_cut_into_bounded_parts(spark):
    items = df(spark, [(i, i % 2, 1, i % 3, f"s{i % 3}", 1 + i % 2, f"c{1 + i % 2}") for i in range(1, 40)], ITEMS)
    docs = DOCUMENTS.to_cohort_definitions(items, ids_per_document=5)
    assert docs.count() > 2
    parsed = I.parse_cohort_definitions(docs)
    assert rows(I.concept_set_items(parsed).drop("createddate")) == rows(items)
    lib = DOCUMENTS.to_library_concept_sets(items, ids_per_document=5)
    log = spark.createDataFrame([(1, "c1", "d"), (2, "c2", "d")], "cohortId bigint, cohortName string, createdDate string")
    assert rows(I.library_items(lib, log).drop("createddate")) == rows(items)


def test_write_a_report_set(spark):
    from conftest import SMALL_SF
    from vocabshift import vocabulary_change_report
    from vocabshift.sources.fixtures import EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS, Fixtures

    fx = Fixtures(spark, SMALL_SF)
    reports = vocabulary_change_report(
        fx.items, fx.old, fx.new, fx.concept_count, events=fx.event_tables, cohort_names=fx.cohort_names,
        excluded_nodes=EXCLUDED_NODES, included_source_vocabs=INCLUDED_SOURCE_VOCABS,
    )
    paths = write_reports(reports, _scratch(spark), project="t_")
    assert set(paths) == {"nonstandard_nodes", "mapping_diff", "domain_change", "cohort_stats"}
    for name, path in paths.items():
        assert read_report(spark, path).count() == reports[name].count()
    reports.close()


def test_readers_of_catalog_tables_and_delimited_text(spark):
    name = f"release_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        concept = "CONCEPT_ID string, Concept_Name string, domain_id string, vocabulary_id string, standard_concept string, concept_code string, extra int"
        df(spark, [("7", 'the "x" test', "Drug", "V", None, "c", 1)], concept).write.saveAsTable(f"{name}.concept")
        df(spark, [(7, 7)], "ancestor_concept_id int, descendant_concept_id int").write.saveAsTable(f"{name}.concept_ancestor")
        df(spark, [(7, 7, "Maps to", None)], "concept_id_1 int, concept_id_2 int, relationship_id string, invalid_reason string").write.saveAsTable(f"{name}.concept_relationship")
        vocab = T.read_vocabulary(spark, name, "table")
        assert rows(vocab.concept) == [(7, 'the "x" test', "Drug", "V", None, "c")]
        assert dict(vocab.ancestor.dtypes) == {"ancestor_concept_id": "bigint", "descendant_concept_id": "bigint"}
        base = _scratch(spark)
        spark.table(f"{name}.concept").write.option("header", True).option("sep", "\t").option("quote", "").csv(f"{base}/concept")
        for table in ("concept_ancestor", "concept_relationship"):
            spark.table(f"{name}.{table}").write.option("header", True).option("sep", "\t").csv(f"{base}/{table}")
        text = T.read_vocabulary(spark, base, "tsv")
        for part in ("concept", "ancestor", "relationship"):
            assert rows(getattr(text, part)) == rows(getattr(vocab, part))
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_readers_name_what_a_table_lacks(spark):
    import pytest

    base = _scratch(spark)
    df(spark, [(1, 2)], "concept_id bigint, record_count bigint").write.parquet(base)
    with pytest.raises(ValueError, match="descendant_record_count"):
        T.read_counts(spark, base)


def test_written_places_over_several_files_and_splits(spark, tmp_path):
    from pyspark.sql import functions as F

    from vocabshift.sinks.reports import written_places

    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        report = spark.range(30_000).select(F.xxhash64("id").alias("key"), "id").orderBy("key")
        paths = write_reports({"r": report}, str(tmp_path))
        placed = written_places(spark, paths["r"])
        assert read_report(spark, paths["r"]).rdd.getNumPartitions() > len(set(placed.inputFiles())) > 1
        got = [(r["place"], r["key"]) for r in placed.orderBy("place").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(i + 1, r["key"]) for i, r in enumerate(report.collect())]
