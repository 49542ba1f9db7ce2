"""Fixture views as DuckDB CTEs (FIXTURES.md §3).

The oracle side of the correctness gate: these CTEs rebuild the same
fixture tables from the driver's ``part``, ``orders`` and ``lineitem``
views, independently of the DataFrame code in ``vocabshift.sources.fixtures``.
Each oracle query is one statement: ``WITH <all fixture CTEs> SELECT ...``.
"""

from __future__ import annotations

# Fixed fixture parameters, as SQL list literals.
EXCLUDED_NODES_SQL = "36, 39"
INCLUDED_SOURCE_VOCABS_SQL = "'ICD10CM', 'ICD9CM', 'CPT4', 'NDC', 'HCPCS'"

FIXTURE_CTES: list[tuple[str, str]] = [
    ("fx_c", "SELECT CAST(p_partkey + 1 AS BIGINT) AS c, p_name FROM part"),
    ("fx_src", "SELECT c, j, 3 * c + j AS s, p_name FROM fx_c, (SELECT unnest([1, 2]) AS j) AS js"),
    (
        "fx_concept_old",
        """
SELECT 3 * c AS concept_id, p_name AS concept_name,
  CASE c % 5 WHEN 0 THEN 'Condition' WHEN 1 THEN 'Procedure' WHEN 2 THEN 'Drug' WHEN 3 THEN 'Measurement' ELSE 'Observation' END AS domain_id,
  'STD' AS vocabulary_id, CASE WHEN c % 23 = 0 THEN NULL WHEN c % 29 = 0 THEN 'C' ELSE 'S' END AS standard_concept,
  concat('S', CAST(c AS VARCHAR)) AS concept_code FROM fx_c
UNION ALL
SELECT s, concat(p_name, ' source'), 'Observation',
  CASE c % 6 WHEN 0 THEN 'ICD10CM' WHEN 1 THEN 'ICD9CM' WHEN 2 THEN 'CPT4' WHEN 3 THEN 'NDC' WHEN 4 THEN 'HCPCS' ELSE 'LOCAL' END,
  NULL, concat('X', CAST(s AS VARCHAR)) FROM fx_src""",
    ),
    (
        "fx_concept_new",
        """
SELECT concept_id, concept_name,
  CASE WHEN concept_id % 3 = 0 AND (concept_id // 3) % 17 = 0 THEN 'Device' ELSE domain_id END AS domain_id, vocabulary_id,
  CASE WHEN concept_id % 3 = 0 AND (concept_id // 3) % 19 = 0 THEN NULL ELSE standard_concept END AS standard_concept, concept_code
FROM fx_concept_old
WHERE NOT (concept_id % 3 = 0 AND (concept_id // 3) % 97 = 0) AND NOT (concept_id % 3 = 2 AND (concept_id // 3) % 101 = 0)""",
    ),
    (
        "fx_tree",
        """
SELECT c, c >> CAST(2 * k AS INTEGER) AS a
FROM (SELECT c, unnest(range(0, (length(bin(c)) + 1) // 2)) AS k FROM fx_c) AS levels""",
    ),
    (
        "fx_ancestor_old",
        "SELECT 3 * a AS ancestor_concept_id, 3 * c AS descendant_concept_id FROM fx_tree WHERE c % 23 <> 0 AND a % 23 <> 0",
    ),
    (
        "fx_ancestor_new",
        """
SELECT 3 * a AS ancestor_concept_id, 3 * c AS descendant_concept_id FROM fx_tree
WHERE c % 23 <> 0 AND a % 23 <> 0 AND a % 19 <> 0 AND c % 19 <> 0 AND a % 97 <> 0 AND c % 97 <> 0 AND (c % 31 <> 0 OR a = c)""",
    ),
    (
        "fx_mapsto_old",
        """
SELECT s AS source_id, 3 * c AS target_id, CASE WHEN c % 41 = 0 THEN 'D' END AS invalid_reason FROM fx_src WHERE c % 43 <> 0
UNION ALL SELECT s, 3 * (c // 2), NULL FROM fx_src WHERE c % 13 = 0 AND j = 1
UNION ALL SELECT s, 21, NULL FROM fx_src WHERE c % 5 = 1 AND j = 2
UNION ALL SELECT 3 * c, 3 * c, NULL FROM fx_c WHERE c % 23 <> 0""",
    ),
    (
        "fx_mapsto_new",
        """
SELECT s AS source_id,
  CASE WHEN c % 19 = 0 THEN 3 * (c // 4) WHEN c % 7 = 0 AND j = 1 THEN 3 * (c + 1) ELSE 3 * c END AS target_id,
  CASE WHEN c % 47 = 0 THEN 'D' END AS invalid_reason FROM fx_src
UNION ALL SELECT s, 3 * (c // 2), NULL FROM fx_src WHERE c % 26 = 0 AND j = 1
UNION ALL SELECT s, 21, NULL FROM fx_src WHERE c % 10 = 1 AND j = 2
UNION ALL SELECT 3 * c, CASE WHEN c % 19 = 0 THEN 3 * (c // 4) ELSE 3 * c END, NULL FROM fx_c WHERE c % 23 <> 0""",
    ),
    (
        "fx_rel_old",
        """
SELECT source_id AS concept_id_1, target_id AS concept_id_2, 'Maps to' AS relationship_id, invalid_reason FROM fx_mapsto_old
UNION ALL SELECT target_id, source_id, 'Mapped from', invalid_reason FROM fx_mapsto_old""",
    ),
    (
        "fx_rel_new",
        """
SELECT source_id AS concept_id_1, target_id AS concept_id_2, 'Maps to' AS relationship_id, invalid_reason FROM fx_mapsto_new
UNION ALL SELECT target_id, source_id, 'Mapped from', invalid_reason FROM fx_mapsto_new
UNION ALL SELECT 3 * c, 3 * (c // 2), 'Maps to value', NULL FROM fx_c WHERE c % 38 = 0""",
    ),
    (
        "fx_items",
        """
SELECT 3 * c AS conceptid, CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END AS isexcluded,
  CASE WHEN c <= 64 OR c % 3 = 0 THEN 1 ELSE 0 END AS includedescendants,
  (c // 8) % 2 AS conceptsetid, concat('set ', CAST((c // 8) % 2 AS VARCHAR)) AS conceptsetname,
  cohort AS cohortid, concat('cohort ', CAST(cohort AS VARCHAR)) AS cohortname
FROM (SELECT c, CASE WHEN c % 3 = 0 THEN 1 ELSE 1 + c % 8 END AS cohort FROM fx_c) AS hot
UNION ALL
SELECT 21, 0, 1, (c // 8) % 2, concat('set ', CAST((c // 8) % 2 AS VARCHAR)), 1 + c % 8, concat('cohort ', CAST(1 + c % 8 AS VARCHAR))
FROM fx_c WHERE c BETWEEN 8 AND 21""",
    ),
    (
        "fx_items_updated",
        """
SELECT CASE WHEN (conceptid // 3) % 19 = 0 THEN 3 * (conceptid // 12) ELSE conceptid END AS conceptid, isexcluded, includedescendants,
  conceptsetid, conceptsetname, cohortid + 100 AS cohortid, cohortname FROM fx_items WHERE (conceptid // 3) % 37 <> 0""",
    ),
    (
        "fx_cohort_pairs",
        """
SELECT DISTINCT cohortid AS old_cohort_id, cohortid + 100 AS new_cohort_id, 'v0' AS old_cohort_vocab_version FROM fx_items
UNION ALL SELECT DISTINCT cohortid, cohortid + 101, 'v1' FROM fx_items WHERE cohortid % 2 = 0""",
    ),
    ("fx_cohort_map", "SELECT * FROM fx_cohort_pairs WHERE old_cohort_vocab_version = 'v0'"),
    ("fx_cohort_names", "SELECT DISTINCT cohortid, cohortname FROM fx_items WHERE cohortid <> 8"),
    (
        "fx_event",
        """
SELECT o_custkey AS person_id, code AS source_concept_id, (code // 3) % 6 AS tbl
FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 31 ELSE 3 * (l_partkey + 1) + 1 + l_linenumber % 2 END AS code FROM lineitem) AS li
JOIN orders ON l_orderkey = o_orderkey""",
    ),
    (
        "fx_record_count",
        "SELECT source_concept_id AS concept_id, count(*) AS record_count FROM fx_event GROUP BY source_concept_id",
    ),
    (
        "fx_concept_count",
        """
SELECT concept_id, record_count, record_count AS descendant_record_count FROM fx_record_count
UNION ALL
SELECT a.ancestor_concept_id, CAST(0 AS BIGINT), CAST(sum(r.record_count) AS BIGINT)
FROM fx_ancestor_old a JOIN fx_mapsto_old m ON m.target_id = a.descendant_concept_id AND m.invalid_reason IS NULL
JOIN fx_record_count r ON r.concept_id = m.source_id GROUP BY a.ancestor_concept_id""",
    ),
    # The six clinical event tables, each with its own source-concept column.
    ("condition_occurrence", "SELECT person_id, source_concept_id AS condition_source_concept_id FROM fx_event WHERE tbl = 0"),
    ("procedure_occurrence", "SELECT person_id, source_concept_id AS procedure_source_concept_id FROM fx_event WHERE tbl = 1"),
    ("drug_exposure", "SELECT person_id, source_concept_id AS drug_source_concept_id FROM fx_event WHERE tbl = 2"),
    ("device_exposure", "SELECT person_id, source_concept_id AS device_source_concept_id FROM fx_event WHERE tbl = 3"),
    ("measurement", "SELECT person_id, source_concept_id AS measurement_source_concept_id FROM fx_event WHERE tbl = 4"),
    ("observation", "SELECT person_id, source_concept_id AS observation_source_concept_id FROM fx_event WHERE tbl = 5"),
]


def with_fixtures(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """One statement: all fixture CTEs, optional extra CTEs, then ``body``."""
    ctes = FIXTURE_CTES + (extra or [])
    head = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)
    return f"WITH {head}\n{body.strip()}"
