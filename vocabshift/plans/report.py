"""User-level reports: the four-table vocabulary change report and the cohort-pair report.

A report is built on first access.  What several consumers read - the
resolved sides, if more than one requested report needs them, the code
difference of the mapping report, the cohort difference of the stats - is
built and run once (``materialize``):

* ``"stage"`` (default): written as Parquet under ``spark.checkpoint.dir``,
  owned by the report set and removed when it is left.  Its consumers' plans
  begin at a scan with known sizes, and a lost executor recomputes nothing.
* ``"persist"`` (MEMORY_AND_DISK, lost blocks recomputed from lineage) and
  ``"checkpoint"``: the resolved sides only.
* ``"none"``: nothing; building starts no job and every consumer recomputes.

A report set is a context manager; leaving it, or ``close()``, releases what
it holds, so its reports are read before.  What a set that was never left holds
goes when the driver ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PAIR_SET_KEYS, SET_KEYS, Vocabulary, normalise_items, source_vocabularies
from ..operators import delta as DELTA
from ..operators import diff as D
from ..operators import domain as DOM
from ..operators import mapping as M
from ..operators import nodes as N
from ..operators import resolve as R
from ..operators import stats as S
from ..session import checkpoint_dir
from ..staging import Staging
from .broadcast import broadcast_if, fits, rows_fit


class ReportSet(Mapping):
    """Named report DataFrames, built on first access, plus the shared intermediates."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]], shared: _Shared):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}
        self.held = shared.held
        self.staging = shared.staging

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def close(self) -> None:
        """Release the persisted and staged intermediates."""
        for df in self.held:
            df.unpersist()
        self.held.clear()
        self.staging.close()

    def __enter__(self) -> ReportSet:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


MATERIALIZE = ("stage", "persist", "checkpoint", "none")

# The resolved sides that each report reads.
SIDES = {
    "nonstandard_nodes": (),
    "mapping_diff": ("old_vc", "new_vc"),
    "domain_change": ("old_vc", "new_vc"),
    "cohort_stats": ("old_vc", "new_vc"),
}


def _requested(reports: Iterable[str] | None, available: Iterable[str]) -> list[str]:
    available = list(available)
    chosen = available if reports is None else list(reports)
    unknown = [r for r in chosen if r not in available]
    if unknown:
        raise ValueError(f"unknown reports {unknown}; available here: {available}")
    return chosen


class _Shared:
    """Intermediates built on first use, kept when they have several readers."""

    def __init__(self, spark: SparkSession, requested: list[str], materialize: str | bool):
        self.readers = {side: sum(side in SIDES[r] for r in requested) for side in ("old_vc", "new_vc")}
        self.materialize = {True: "stage", False: "none"}.get(materialize, materialize)
        if self.materialize not in MATERIALIZE:
            raise ValueError(f"materialize must be one of {MATERIALIZE}")
        self.built: dict[str, DataFrame] = {}
        self.held: list[DataFrame] = []
        self.staging = Staging(spark, "reports")

    @property
    def staged(self) -> bool:
        return self.materialize == "stage"

    def __call__(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """``build()``, kept if it is a resolved side of several reports or, where tables are staged, a difference."""
        if name not in self.built:
            df = build()
            side = name in self.readers
            if self.staged and self.readers.get(name, 2) > 1:
                df = self.staging.put(df, name)
            elif side and self.readers[name] > 1 and self.materialize == "persist":
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                self.held.append(df)
            elif side and self.readers[name] > 1 and self.materialize == "checkpoint":
                checkpoint_dir(df.sparkSession)
                df = df.checkpoint(eager=True)
            self.built[name] = df
        return self.built[name]


def vocabulary_change_report(
    items: DataFrame,
    old: Vocabulary,
    new: Vocabulary,
    counts: DataFrame,
    events: Mapping[str, DataFrame] | DataFrame | None = None,
    cohort_names: DataFrame | None = None,
    excluded_nodes: Iterable[int] | None = (),
    included_source_vocabs: Iterable[str] | None = None,
    changed_only: bool = False,
    stats_valid_edges_only: bool = False,
    materialize: str = "stage",
    reports: Iterable[str] | None = None,
    difference: str = "full",
) -> ReportSet:
    """``nonstandard_nodes``, ``mapping_diff``, ``domain_change`` and (with events) ``cohort_stats``.

    ``events`` is either the six event tables by name or one DataFrame of
    ``(person_id, source_concept_id)``.  ``included_source_vocabs=None``
    keeps every source vocabulary; an empty list is an error.  ``reports``
    names the wanted reports (default: all).  ``difference="delta"`` finds the
    codes of the mapping report from the concepts and edges that changed
    (for releases that share most of them), ``"full"`` from both resolved sides.
    """
    if difference not in ("full", "delta"):
        raise ValueError('difference must be "full" or "delta"')
    items = normalise_items(items)
    vocabs = source_vocabularies(included_source_vocabs)
    small = fits(items)
    available = ["nonstandard_nodes", "mapping_diff", "domain_change"] + (["cohort_stats"] if events is not None else [])
    requested = _requested(reports, available)
    shared = _Shared(old.concept.sparkSession, requested, materialize)

    def old_vc() -> DataFrame:
        return shared("old_vc", lambda: R.resolve_concepts(items, old, excluded_nodes, SET_KEYS, small))

    def new_vc() -> DataFrame:
        return shared("new_vc", lambda: R.resolve_concepts(items, new, excluded_nodes, SET_KEYS, small))

    def full_difference() -> DataFrame:
        return D.source_concept_diff(D.source_concepts(old_vc(), old), D.source_concepts(new_vc(), new))

    def delta_difference() -> DataFrame:
        hold = lambda df, name: shared(name, lambda: df)
        return DELTA.source_concept_diff_by_delta(items, old, new, excluded_nodes, SET_KEYS, small, hold)

    def mapping_diff() -> DataFrame:
        dif = shared("dif", delta_difference if difference == "delta" else full_difference)
        return M.mapping_diff_one_pass(dif, old, new, counts, SET_KEYS, vocabs, changed_only)

    def cohort_stats() -> DataFrame:
        ev = events if isinstance(events, DataFrame) else S.union_events(events)
        cdiff = shared(
            "cdiff", lambda: S.concept_diff(S.concept_pool(old_vc(), new_vc(), old, new, vocabs, stats_valid_edges_only))
        )
        small = shared.staged and rows_fit(cdiff, S.WORD_ROW_BYTES)  # counted rows of fixed width
        flags = S.person_flags(ev, cdiff, small)
        summary = S.person_change_summary_from_flags(flags)
        return S.cohort_stats(summary, S.concept_count_change(cdiff), cohort_names)

    builders = {
        "nonstandard_nodes": lambda: N.nonstandard_nodes(items, new, counts, SET_KEYS, small),
        "mapping_diff": mapping_diff,
        "domain_change": lambda: DOM.domain_change(
            DOM.common_concepts(old_vc(), new_vc()), old, new, counts, SET_KEYS, vocabs
        ),
    }
    if events is not None:
        builders["cohort_stats"] = cohort_stats
    return ReportSet({name: builders[name] for name in requested}, shared)


def cohort_pair_report(
    items_old: DataFrame,
    items_new: DataFrame,
    cohort_map: DataFrame,
    old: Vocabulary,
    new: Vocabulary,
    counts: DataFrame,
    excluded_nodes: Iterable[int] | None = (),
    included_source_vocabs: Iterable[str] | None = None,
    changed_only: bool = True,
    materialize: str = "stage",
    reports: Iterable[str] | None = None,
) -> ReportSet:
    """Old cohorts on the old vocabulary vs their updated versions on the new one.

    ``cohort_map`` holds ``old_cohort_id, new_cohort_id`` (and any other
    columns, e.g. ``old_cohort_vocab_version``, which are appended to the
    mapping and domain reports).  New cohort ids are translated to old ids
    before comparing, so sets match on (old cohort id, set name, set id).
    """
    items_old = normalise_items(items_old)
    items_new = normalise_items(items_new)
    vocabs = source_vocabularies(included_source_vocabs)
    small = fits(items_old, items_new)
    map_small = fits(cohort_map)
    requested = _requested(reports, ("nonstandard_nodes", "mapping_diff", "domain_change"))
    shared = _Shared(old.concept.sparkSession, requested, materialize)

    def old_vc() -> DataFrame:
        return shared("old_vc", lambda: R.resolve_concepts(items_old, old, excluded_nodes, PAIR_SET_KEYS, small))

    def new_vc() -> DataFrame:
        return shared(
            "new_vc",
            lambda: R.translate_cohort_ids(
                R.resolve_concepts(items_new, new, excluded_nodes, PAIR_SET_KEYS, small), cohort_map, map_small
            ),
        )

    def mapping_diff() -> DataFrame:
        dif = shared(
            "dif",
            lambda: D.source_concept_diff(
                D.source_concepts(old_vc(), old, PAIR_SET_KEYS),
                D.source_concepts(new_vc(), new, PAIR_SET_KEYS),
                PAIR_SET_KEYS,
            ),
        )
        mapdif = M.mapping_diff_one_pass(dif, old, new, counts, PAIR_SET_KEYS, vocabs, changed_only, sort=False)
        return with_pair_columns(mapdif, cohort_map, map_small).orderBy(*M.report_order(PAIR_SET_KEYS), "new_cohort_id")

    def domain_change() -> DataFrame:
        domain = DOM.domain_change(
            DOM.common_concepts(old_vc(), new_vc()), old, new, counts, PAIR_SET_KEYS, vocabs, sort=False
        )
        return with_pair_columns(domain, cohort_map, map_small).orderBy(*DOM.report_order(PAIR_SET_KEYS), "new_cohort_id")

    builders = {
        "nonstandard_nodes": lambda: N.nonstandard_nodes(items_new, new, counts, SET_KEYS, small),
        "mapping_diff": mapping_diff,
        "domain_change": domain_change,
    }
    return ReportSet({name: builders[name] for name in requested}, shared)


def with_pair_columns(df: DataFrame, cohort_map: DataFrame, small: bool | None = None) -> DataFrame:
    """Append the pair table's columns (inner join ``cohortid = old_cohort_id``)."""
    small = fits(cohort_map) if small is None else small
    m = broadcast_if(cohort_map, small)
    extra = [c for c in cohort_map.columns if c != "old_cohort_id"]
    return df.join(m, F.col("cohortid") == F.col("old_cohort_id")).select(*df.columns, *extra)
