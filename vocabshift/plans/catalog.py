"""Registered queries: each operator run over the fixture tables of one scale factor.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
work grows with the driver tables under ``sf_dir`` (the fixtures are
derived from ``part``, ``orders`` and ``lineitem``).  Queries that test a
file source or sink write its files under the shared checkpoint folder while
they are built; all others are lazy and start no job.  Nothing stays
persisted.  Parameters are the fixture parameters (``EXCLUDED_NODES``,
``INCLUDED_SOURCE_VOCABS``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ITEM_COLUMNS, PAIR_SET_KEYS, SET_KEYS
from ..operators import delta as DELTA
from ..operators import diff as D
from ..operators import domain as DOM
from ..operators import mapping as M
from ..operators import nodes as N
from ..operators import resolve as R
from ..operators import stats as S
from ..sinks.events import write_event_layout
from ..sinks.reports import read_report, write_reports, written_places
from ..sources import documents as DOCS
from ..sources import items as I
from ..sources.fixtures import EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS, PAIR_VERSION, Fixtures, inputs_for
from ..sources.tables import read_cohort_map, read_cohort_names, read_counts, read_events, read_vocabulary
from ..staging import Staging
from .broadcast import fits
from .report import cohort_pair_report, vocabulary_change_report

Query = Callable[[SparkSession, str], DataFrame]
LOG_CREATED_DATE = "2024-01-01"


class _Main:
    """Shared main-path building blocks for one fixture set."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.fx = inputs_for(spark, sf_dir)

    @cached_property
    def small(self) -> bool:
        return fits(self.fx.items)

    @cached_property
    def old_vc(self) -> DataFrame:
        return R.resolve_concepts(self.fx.items, self.fx.old, EXCLUDED_NODES, SET_KEYS, self.small)

    @cached_property
    def new_vc(self) -> DataFrame:
        return R.resolve_concepts(self.fx.items, self.fx.new, EXCLUDED_NODES, SET_KEYS, self.small)

    @cached_property
    def old_sc(self) -> DataFrame:
        return D.source_concepts(self.old_vc, self.fx.old)

    @cached_property
    def new_sc(self) -> DataFrame:
        return D.source_concepts(self.new_vc, self.fx.new)

    @cached_property
    def dif(self) -> DataFrame:
        return D.source_concept_diff(self.old_sc, self.new_sc)

    def mapping_old(self, vocabs=INCLUDED_SOURCE_VOCABS) -> DataFrame:
        fx = self.fx
        return M.mapping_old(self.dif, fx.old, fx.new, fx.concept_count, SET_KEYS, vocabs)

    def mapping_new(self) -> DataFrame:
        return M.mapping_new(self.dif, self.fx.new)

    def old_agg(self) -> DataFrame:
        return M.aggregate_mapping(self.mapping_old(), M.old_aggregate_keys(), "old")

    def new_agg(self) -> DataFrame:
        return M.aggregate_mapping(self.mapping_new(), M.new_aggregate_keys(), "new")

    def common(self) -> DataFrame:
        return DOM.common_concepts(self.old_vc, self.new_vc)

    def pool(self) -> DataFrame:
        fx = self.fx
        return S.concept_pool(self.old_vc, self.new_vc, fx.old, fx.new, INCLUDED_SOURCE_VOCABS)

    def events(self) -> DataFrame:
        return S.union_events(self.fx.event_tables)


def _pair_report(spark: SparkSession, sf_dir: str, name: str, changed_only: bool = True) -> DataFrame:
    """One report of the pair path (so nothing is persisted)."""
    fx = inputs_for(spark, sf_dir)
    return cohort_pair_report(
        fx.items, fx.items_updated, fx.cohort_map, fx.old, fx.new, fx.concept_count,
        EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS, changed_only=changed_only, reports=[name],
    )[name]


def q_pair_mapping_diff_all(spark, sf_dir):
    """Pair mapping report with every differing code, mapping text changed or not."""
    return _pair_report(spark, sf_dir, "mapping_diff", changed_only=False)


def _pair_blocks(spark: SparkSession, sf_dir: str):
    fx = inputs_for(spark, sf_dir)
    small = fits(fx.items, fx.items_updated)
    old_vc = R.resolve_concepts(fx.items, fx.old, EXCLUDED_NODES, PAIR_SET_KEYS, small)
    new_vc = R.resolve_concepts(fx.items_updated, fx.new, EXCLUDED_NODES, PAIR_SET_KEYS, small)
    return fx, old_vc, new_vc


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint folder, removed when the driver ends."""
    return Staging(spark, "scratch").folder(name)


def q_items(spark, sf_dir):
    return inputs_for(spark, sf_dir).items


def q_concept_count(spark, sf_dir):
    return inputs_for(spark, sf_dir).concept_count


def q_nonstandard_nodes(spark, sf_dir):
    fx = inputs_for(spark, sf_dir)
    return N.nonstandard_nodes(fx.items, fx.new, fx.concept_count)


def q_nonstandard_nodes_pair(spark, sf_dir):
    return _pair_report(spark, sf_dir, "nonstandard_nodes")


def q_resolve_old(spark, sf_dir):
    return _Main(spark, sf_dir).old_vc


def q_resolve_new(spark, sf_dir):
    return _Main(spark, sf_dir).new_vc


def q_resolve_all_nodes(spark, sf_dir):
    fx = inputs_for(spark, sf_dir)
    return R.resolve_concepts(fx.items, fx.new, ())


def q_resolve_included_only(spark, sf_dir):
    fx = inputs_for(spark, sf_dir)
    return R.included_concepts(fx.items, fx.new, EXCLUDED_NODES)


def q_source_concepts_old(spark, sf_dir):
    return _Main(spark, sf_dir).old_sc


def q_source_concepts_new(spark, sf_dir):
    return _Main(spark, sf_dir).new_sc


def q_source_removed(spark, sf_dir):
    m = _Main(spark, sf_dir)
    return D.removed_sources(m.old_sc, m.new_sc)


def q_source_added(spark, sf_dir):
    m = _Main(spark, sf_dir)
    return D.added_sources(m.old_sc, m.new_sc)


def q_source_diff(spark, sf_dir):
    m = _Main(spark, sf_dir)
    return D.source_concept_diff_two_pass(m.old_sc, m.new_sc)


def q_source_diff_onepass(spark, sf_dir):
    return _Main(spark, sf_dir).dif


def q_resolve_words_old(spark, sf_dir):
    """Resolution by words of sets, old version."""
    fx = inputs_for(spark, sf_dir)
    return DELTA.resolve_concepts_by_words(fx.items, fx.old, EXCLUDED_NODES)


def q_resolve_words_new(spark, sf_dir):
    """Resolution by words of sets, new version."""
    fx = inputs_for(spark, sf_dir)
    return DELTA.resolve_concepts_by_words(fx.items, fx.new, EXCLUDED_NODES)


def q_source_diff_delta(spark, sf_dir):
    """Removed / Added codes from the concepts and edges that changed."""
    fx = inputs_for(spark, sf_dir)
    return DELTA.source_concept_diff_by_delta(fx.items, fx.old, fx.new, EXCLUDED_NODES)


def q_mapping_diff_delta(spark, sf_dir):
    """The mapping report over the difference from what changed."""
    return _main_report(spark, sf_dir, "mapping_diff", difference="delta")


def q_mapping_old(spark, sf_dir):
    return _Main(spark, sf_dir).mapping_old()


def q_mapping_new(spark, sf_dir):
    return _Main(spark, sf_dir).mapping_new()


def q_mapping_old_all_vocabs(spark, sf_dir):
    return _Main(spark, sf_dir).mapping_old(vocabs=None)


def q_mapping_agg_old(spark, sf_dir):
    return _Main(spark, sf_dir).old_agg()


def q_mapping_agg_new(spark, sf_dir):
    return _Main(spark, sf_dir).new_agg()


def _main_report(spark, sf_dir, name: str, vocabs=INCLUDED_SOURCE_VOCABS, **kw) -> DataFrame:
    """One report of the main path (so nothing is persisted)."""
    fx = inputs_for(spark, sf_dir)
    if name == "cohort_stats":
        kw["events"] = fx.event_tables
    return vocabulary_change_report(
        fx.items, fx.old, fx.new, fx.concept_count, cohort_names=fx.cohort_names,
        excluded_nodes=EXCLUDED_NODES, included_source_vocabs=vocabs, reports=[name], **kw,
    )[name]


def q_mapping_diff_all_vocabs(spark, sf_dir):
    """Every source vocabulary (``included_source_vocabs=None``)."""
    return _main_report(spark, sf_dir, "mapping_diff", vocabs=None)


def q_cohort_stats_valid_edges(spark, sf_dir):
    """Stats counting valid ``Mapped from`` edges only."""
    return _main_report(spark, sf_dir, "cohort_stats", stats_valid_edges_only=True)


def q_mapping_diff(spark, sf_dir):
    return _main_report(spark, sf_dir, "mapping_diff")


def q_mapping_diff_changed(spark, sf_dir):
    return _main_report(spark, sf_dir, "mapping_diff", changed_only=True)


def q_domain_change_report(spark, sf_dir):
    """The domain report through the report function."""
    return _main_report(spark, sf_dir, "domain_change")


def q_nonstandard_nodes_report(spark, sf_dir):
    """The node report through the report function."""
    return _main_report(spark, sf_dir, "nonstandard_nodes")


# -- written order ---------------------------------------------------------------
def _places(spark: SparkSession, report: DataFrame, name: str) -> DataFrame:
    """The written report with the place of every row in the order it was written in."""
    return written_places(spark, write_reports({name: report}, _scratch(spark, "order"))[name])


def q_nonstandard_nodes_order(spark, sf_dir):
    return _places(spark, q_nonstandard_nodes_report(spark, sf_dir), "nonstandard_nodes")


def q_mapping_diff_order(spark, sf_dir):
    return _places(spark, q_mapping_diff(spark, sf_dir), "mapping_diff")


def q_domain_change_order(spark, sf_dir):
    return _places(spark, q_domain_change_report(spark, sf_dir), "domain_change")


def q_cohort_stats_order(spark, sf_dir):
    return _places(spark, q_cohort_stats(spark, sf_dir), "cohort_stats")


def q_pair_mapping_diff_order(spark, sf_dir):
    return _places(spark, q_pair_mapping_diff(spark, sf_dir), "mapping_diff")


def q_pair_domain_change_order(spark, sf_dir):
    return _places(spark, q_pair_domain_change(spark, sf_dir), "domain_change")


# -- reports from tables that the readers read -----------------------------------------
def _delivered(spark: SparkSession, sf_dir: str):
    """The inputs as a site delivers them, read by the library's readers.

    The old vocabulary is tab-separated text, the new one Parquet; counts and events are Parquet, names and pairs CSV.
    """
    fx = inputs_for(spark, sf_dir)
    if isinstance(fx, Fixtures):
        fx.hold_events(Staging(spark, "scratch"))
    base = _scratch(spark, "delivered")
    for version, vocab, text in (("old", fx.old, True), ("new", fx.new, False)):
        for name, df in (
            ("concept", vocab.concept),
            ("concept_ancestor", vocab.ancestor),
            ("concept_relationship", vocab.relationship),
        ):
            if text:
                df.write.option("header", True).option("sep", "\t").csv(f"{base}/{version}/{name}")
            else:
                df.write.parquet(f"{base}/{version}/{name}")
    fx.concept_count.write.parquet(f"{base}/counts")
    for name, df in fx.event_tables.items():
        df.write.parquet(f"{base}/events/{name}")
    fx.cohort_names.write.option("header", True).csv(f"{base}/names")
    fx.cohort_pairs.write.option("header", True).csv(f"{base}/pairs")
    return {
        "items": fx.items,
        "items_updated": fx.items_updated,
        "old": read_vocabulary(spark, f"{base}/old", "tsv"),
        "new": read_vocabulary(spark, f"{base}/new"),
        "counts": read_counts(spark, f"{base}/counts"),
        "events": read_events(spark, f"{base}/events"),
        "names": read_cohort_names(spark, f"{base}/names"),
        "pairs": read_cohort_map(spark, f"{base}/pairs", PAIR_VERSION),
    }


def _from_tables(name: str):
    def query(spark, sf_dir):
        d = _delivered(spark, sf_dir)
        return vocabulary_change_report(
            d["items"], d["old"], d["new"], d["counts"], d["events"], d["names"], EXCLUDED_NODES,
            INCLUDED_SOURCE_VOCABS, reports=[name],
        )[name]

    return query


def _pair_from_tables(name: str):
    def query(spark, sf_dir):
        d = _delivered(spark, sf_dir)
        return cohort_pair_report(
            d["items"], d["items_updated"], d["pairs"], d["old"], d["new"], d["counts"], EXCLUDED_NODES,
            INCLUDED_SOURCE_VOCABS, reports=[name],
        )[name]

    return query


def _written(name: str):
    """One report of a run that writes all four with a prefix and camelCase headers, their shared sides staged."""

    def query(spark, sf_dir):
        fx = inputs_for(spark, sf_dir)
        reports = vocabulary_change_report(
            fx.items, fx.old, fx.new, fx.concept_count, fx.event_tables, fx.cohort_names, EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS
        )
        with reports:
            paths = write_reports(reports, _scratch(spark, "reports"), project="study_", camel_case=True)
        return read_report(spark, paths[name])

    return query


def _written_pair(name: str):
    """One report of a run that writes all reports of the pair path."""

    def query(spark, sf_dir):
        fx = inputs_for(spark, sf_dir)
        reports = cohort_pair_report(
            fx.items, fx.items_updated, fx.cohort_map, fx.old, fx.new, fx.concept_count, EXCLUDED_NODES, INCLUDED_SOURCE_VOCABS
        )
        with reports:
            paths = write_reports(reports, _scratch(spark, "pair-reports"), project="pair_", camel_case=True)
        return read_report(spark, paths[name])

    return query


def q_person_flags_layout(spark, sf_dir):
    """Person flags over the events laid out by person."""
    m = _Main(spark, sf_dir)
    path = _scratch(spark, "layout")
    table = "events_" + path.rsplit("-", 1)[1]
    layout = write_event_layout(m.events(), table, int(spark.conf.get("spark.sql.shuffle.partitions")), path)
    return S.person_flags(layout, S.concept_diff(m.pool()))


def q_cohort_map_table(spark, sf_dir):
    """The pairs read from a catalog table (here a view)."""
    name = "pairs_" + _scratch(spark, "pairs").rsplit("-", 1)[1]
    inputs_for(spark, sf_dir).cohort_pairs.createOrReplaceTempView(name)
    return read_cohort_map(spark, name, PAIR_VERSION, "table")


def q_common_concepts(spark, sf_dir):
    return _Main(spark, sf_dir).common()


def q_domain_change(spark, sf_dir):
    m = _Main(spark, sf_dir)
    fx = m.fx
    return DOM.domain_change(m.common(), fx.old, fx.new, fx.concept_count, SET_KEYS, INCLUDED_SOURCE_VOCABS)


def q_domain_change_all_vocabs(spark, sf_dir):
    m = _Main(spark, sf_dir)
    fx = m.fx
    return DOM.domain_change(m.common(), fx.old, fx.new, fx.concept_count, SET_KEYS, None)


def q_concept_pool(spark, sf_dir):
    return _Main(spark, sf_dir).pool()


def q_concept_diff(spark, sf_dir):
    return S.concept_diff(_Main(spark, sf_dir).pool())


def q_concept_count_change(spark, sf_dir):
    return S.concept_count_change(S.concept_diff(_Main(spark, sf_dir).pool()))


def q_matched_events(spark, sf_dir):
    m = _Main(spark, sf_dir)
    return S.matched_events(m.events(), S.concept_diff(m.pool()))


def q_person_flags(spark, sf_dir):
    m = _Main(spark, sf_dir)
    return S.person_flags(m.events(), S.concept_diff(m.pool()))


def q_flag_histogram(spark, sf_dir):
    m = _Main(spark, sf_dir)
    return S.flag_histogram(S.person_flags(m.events(), S.concept_diff(m.pool())))


def q_person_change_summary(spark, sf_dir):
    m = _Main(spark, sf_dir)
    return S.person_change_summary(S.flag_histogram(S.person_flags(m.events(), S.concept_diff(m.pool()))))


def q_cohort_stats(spark, sf_dir):
    return _main_report(spark, sf_dir, "cohort_stats")


def q_pair_resolve_new(spark, sf_dir):
    return _pair_blocks(spark, sf_dir)[2]


def q_pair_source_diff(spark, sf_dir):
    fx, old_vc, new_vc = _pair_blocks(spark, sf_dir)
    new_old_ids = R.translate_cohort_ids(new_vc, fx.cohort_map)
    return D.source_concept_diff(
        D.source_concepts(old_vc, fx.old, PAIR_SET_KEYS),
        D.source_concepts(new_old_ids, fx.new, PAIR_SET_KEYS),
        PAIR_SET_KEYS,
    )


def q_pair_mapping_diff(spark, sf_dir):
    return _pair_report(spark, sf_dir, "mapping_diff")


def q_pair_domain_change(spark, sf_dir):
    return _pair_report(spark, sf_dir, "domain_change")


def q_items_json(spark, sf_dir):
    fx = inputs_for(spark, sf_dir)
    docs = I.parse_cohort_definitions(DOCS.to_cohort_definitions(fx.items))
    return I.concept_set_items(docs).select(*ITEM_COLUMNS)


def q_items_json_files(spark, sf_dir):
    """Definition documents written as JSON-lines files, read back with the declared schema."""
    path = _scratch(spark, "definitions")
    DOCS.to_cohort_definitions(inputs_for(spark, sf_dir).items).write.text(path)
    return I.concept_set_items(I.read_cohort_definitions(spark, path, multi_line=False)).select(*ITEM_COLUMNS)


def q_library_items(spark, sf_dir):
    fx = inputs_for(spark, sf_dir)
    library = DOCS.to_library_concept_sets(fx.items)
    log = fx.cohort_names.select(
        F.col("cohortid").alias("cohortId"),
        F.col("cohortname").alias("cohortName"),
        F.lit(LOG_CREATED_DATE).alias("createdDate"),
    )
    return I.library_items(library, log)


def q_report_roundtrip(spark, sf_dir):
    """Write the mapping report with the report sink and read it back."""
    paths = write_reports({"mapping_diff": q_mapping_diff(spark, sf_dir)}, _scratch(spark, "reports"))
    return read_report(spark, paths["mapping_diff"])


def q_cohort_map_csv(spark, sf_dir):
    """Write the pair table as CSV and read it back for one vocabulary version."""
    path = _scratch(spark, "cohort-map")
    inputs_for(spark, sf_dir).cohort_pairs.write.option("header", True).csv(path)
    return read_cohort_map(spark, path, version=PAIR_VERSION)


def _dated_items(fx) -> DataFrame:
    day = (F.lit(1) + F.col("cohortid") % 9).cast("string")
    return fx.items.withColumn("createddate", F.concat(F.lit("2024-01-0"), day))


def q_definitions_createddate(spark, sf_dir):
    """Items of dated definitions, the date kept."""
    docs = DOCS.to_cohort_definitions(_dated_items(inputs_for(spark, sf_dir)))
    return I.concept_set_items(I.parse_cohort_definitions(docs)).select(*ITEM_COLUMNS, "createddate")


def _odd_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition files: every fourth cohort's text is cut off; each other cohort also has a document without
    concept sets and one with a set without items."""
    path = _scratch(spark, "odd-definitions")
    items = inputs_for(spark, sf_dir).items
    docs = DOCS.to_cohort_definitions(items)
    cohort = F.get_json_object("definition", "$.id").cast("bigint")
    cut = F.substring("definition", 1, 30)
    texts = docs.select(F.when(cohort % 4 == 0, cut).otherwise(F.col("definition")).alias("definition"))
    good = items.select("cohortid").distinct().where("cohortid % 4 <> 0")
    bare = good.select(F.format_string('{"id": %d, "name": "bare", "expression": {"ConceptSets": []}}', "cohortid").alias("definition"))
    hollow = good.select(
        F.format_string(
            '{"id": %d, "name": "hollow", "expression": {"ConceptSets": [{"id": 9, "name": "x", "expression": {"items": []}}]}}',
            "cohortid",
        ).alias("definition")
    )
    texts.unionByName(bare).unionByName(hollow).write.text(path)
    return I.read_cohort_definitions(spark, path, multi_line=False)


def q_definitions_odd_documents(spark, sf_dir):
    """Items of definition files among which some are corrupt, some have no sets and some sets have no items."""
    return I.concept_set_items(_odd_definitions(spark, sf_dir)).select(*ITEM_COLUMNS)


def q_missing_cohorts(spark, sf_dir):
    """Requested cohorts without a parsable definition: unknown ids and corrupt documents."""
    known = inputs_for(spark, sf_dir).items.select("cohortid").distinct()
    requested = known.unionByName(known.select((F.col("cohortid") + 1000).alias("cohortid")))
    return I.missing_cohorts(requested, _odd_definitions(spark, sf_dir))


def q_person_flags_streaming(spark, sf_dir):
    """Person flags kept by the incremental stream over the event tables written as files."""
    from ..streaming.person_flags import current_flags, read_event_streams, start_person_flags

    m = _Main(spark, sf_dir)
    base = _scratch(spark, "stream")
    paths = {}
    for name, events in m.fx.event_tables.items():
        paths[name] = f"{base}/events/{name}"
        events.write.parquet(paths[name])
    diff = S.concept_diff(m.pool())
    events = read_event_streams(spark, paths, max_files_per_trigger=64)
    query = start_person_flags(events, diff, f"{base}/flags", f"{base}/ckpt", "v1")
    query.awaitTermination()
    return current_flags(spark, f"{base}/flags", "v1")


QUERIES: dict[str, Query] = {
    "fx_concept_set_items": q_items,
    "fx_concept_count": q_concept_count,
    "nonstandard_nodes": q_nonstandard_nodes,
    "nonstandard_nodes_pair": q_nonstandard_nodes_pair,
    "resolve_concepts_old": q_resolve_old,
    "resolve_concepts_new": q_resolve_new,
    "resolve_concepts_all_nodes": q_resolve_all_nodes,
    "resolve_concepts_included_only": q_resolve_included_only,
    "source_concepts_old": q_source_concepts_old,
    "source_concepts_new": q_source_concepts_new,
    "source_concept_removed": q_source_removed,
    "source_concept_added": q_source_added,
    "source_concept_diff": q_source_diff,
    "source_concept_diff_onepass": q_source_diff_onepass,
    "resolve_concepts_words_old": q_resolve_words_old,
    "resolve_concepts_words_new": q_resolve_words_new,
    "source_concept_diff_delta": q_source_diff_delta,
    "mapping_diff_delta": q_mapping_diff_delta,
    "mapping_old": q_mapping_old,
    "mapping_new": q_mapping_new,
    "mapping_old_all_vocabs": q_mapping_old_all_vocabs,
    "mapping_agg_old": q_mapping_agg_old,
    "mapping_agg_new": q_mapping_agg_new,
    "mapping_diff": q_mapping_diff,
    "mapping_diff_changed": q_mapping_diff_changed,
    "mapping_diff_all_vocabs": q_mapping_diff_all_vocabs,
    "common_concepts": q_common_concepts,
    "domain_change": q_domain_change,
    "domain_change_all_vocabs": q_domain_change_all_vocabs,
    "concept_pool": q_concept_pool,
    "concept_diff": q_concept_diff,
    "concept_count_change": q_concept_count_change,
    "matched_events": q_matched_events,
    "person_flags": q_person_flags,
    "person_flags_streaming": q_person_flags_streaming,
    "flag_histogram": q_flag_histogram,
    "person_change_summary": q_person_change_summary,
    "cohort_stats": q_cohort_stats,
    "cohort_stats_valid_edges": q_cohort_stats_valid_edges,
    "pair_resolve_new": q_pair_resolve_new,
    "pair_source_concept_diff": q_pair_source_diff,
    "pair_mapping_diff": q_pair_mapping_diff,
    "pair_mapping_diff_all": q_pair_mapping_diff_all,
    "pair_domain_change": q_pair_domain_change,
    "concept_set_items_json": q_items_json,
    "concept_set_items_json_files": q_items_json_files,
    "library_items_with_names": q_library_items,
    "report_roundtrip": q_report_roundtrip,
    "cohort_map_csv": q_cohort_map_csv,
    "domain_change_report": q_domain_change_report,
    "nonstandard_nodes_report": q_nonstandard_nodes_report,
    "nonstandard_nodes_order": q_nonstandard_nodes_order,
    "mapping_diff_order": q_mapping_diff_order,
    "domain_change_order": q_domain_change_order,
    "cohort_stats_order": q_cohort_stats_order,
    "pair_mapping_diff_order": q_pair_mapping_diff_order,
    "pair_domain_change_order": q_pair_domain_change_order,
    "tables_nonstandard_nodes": _from_tables("nonstandard_nodes"),
    "tables_mapping_diff": _from_tables("mapping_diff"),
    "tables_domain_change": _from_tables("domain_change"),
    "tables_cohort_stats": _from_tables("cohort_stats"),
    "tables_pair_mapping_diff": _pair_from_tables("mapping_diff"),
    "tables_pair_domain_change": _pair_from_tables("domain_change"),
    **{f"written_{name}": _written(name) for name in ("nonstandard_nodes", "mapping_diff", "domain_change", "cohort_stats")},
    **{f"written_pair_{name}": _written_pair(name) for name in ("nonstandard_nodes", "mapping_diff", "domain_change")},
    "person_flags_layout": q_person_flags_layout,
    "cohort_map_table": q_cohort_map_table,
    "definitions_createddate": q_definitions_createddate,
    "definitions_odd_documents": q_definitions_odd_documents,
    "missing_cohorts": q_missing_cohorts,
}
