"""vocabshift: what a new clinical-vocabulary release changes in cohort definitions, on Spark."""

from .model import Vocabulary, normalise_items
from .plans.report import ReportSet, cohort_pair_report, vocabulary_change_report
from .sinks.reports import write_reports

__all__ = [
    "ReportSet",
    "Vocabulary",
    "cohort_pair_report",
    "normalise_items",
    "vocabulary_change_report",
    "write_reports",
]
