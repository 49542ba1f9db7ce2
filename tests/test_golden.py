"""The three worked examples of the reference's documentation as golden rows."""

from helpers import COUNTS, ITEMS, df, maps, rows, vocab

from vocabshift import vocabulary_change_report


def test_nonstandard_node_with_replacements(spark):
    items = df(spark, [(4324190, 0, 1, 15, "Malignancies that spread to liver", 10729, "Malignant neoplasms")], ITEMS)
    concepts = [
        (4324190, "History of malignant neoplasm of breast", "Observation", "SNOMED", None, "429740004"),
        (1340204, "History of event", "Observation", "OMOP Extension", "S", "OMOP4822340"),
        (4112853, "Malignant tumor of breast", "Condition", "SNOMED", "S", "254837009"),
    ]
    rel = maps(4324190, 1340204) + [(4324190, 4112853, "Maps to value", None)]
    new = vocab(spark, concepts, [], rel)
    old = vocab(spark, concepts, [], [])
    counts = df(spark, [(4324190, 5, 20284048)], COUNTS)
    out = vocabulary_change_report(items, old, new, counts)["nonstandard_nodes"]
    assert rows(out) == [
        (
            10729, "Malignant neoplasms", "Malignancies that spread to liver", 15, 0, 1,
            4324190, "History of malignant neoplasm of breast", 20284048,
            1340204, "History of event", 4112853, "Malignant tumor of breast",
        )
    ]


def test_mapping_difference_added_code(spark):
    node = 4000001
    items = df(spark, [(node, 0, 1, 28, "Cranial nerve disorder", 12822, "Nerve disorders")], ITEMS)
    concepts = [
        (node, "Disorder of cranial nerve", "Condition", "SNOMED", "S", "128212003"),
        (381312, "Neural hearing loss", "Condition", "SNOMED", "S", "73371001"),
        (379831, "Unilateral neural hearing loss", "Condition", "SNOMED", "S", "425601005"),
        (44823107, "Neural hearing loss, unilateral", "Condition", "ICD9CM", None, "389.13"),
    ]
    anc = [(node, node), (node, 381312), (381312, 381312), (379831, 379831)]
    old = vocab(spark, concepts, anc, maps(44823107, 379831))
    new = vocab(spark, concepts, anc, maps(44823107, 381312))
    counts = df(spark, [(44823107, 7115, 7115)], COUNTS)
    out = vocabulary_change_report(items, old, new, counts, included_source_vocabs=["ICD9CM"])["mapping_diff"]
    assert rows(out) == [
        (
            12822, "Nerve disorders", "Cranial nerve disorder", 28, 44823107, 7115, "Added",
            "Neural hearing loss, unilateral", "ICD9CM", "389.13",
            "379831", "Unilateral neural hearing loss", "SNOMED", "425601005",
            "381312", "Neural hearing loss", "SNOMED", "73371001",
        )
    ]


def test_domain_change(spark):
    items = df(spark, [(436222, 0, 0, 1, "Altered mental status", 123, "Altered mental status")], ITEMS)
    src = 45534422
    old_c = [
        (436222, "Altered mental status", "Condition", "SNOMED", "S", "419284004"),
        (src, "Altered mental status, unspecified", "Condition", "ICD10CM", None, "R41.82"),
    ]
    new_c = [(436222, "Altered mental status", "Observation", "SNOMED", "S", "419284004"), old_c[1]]
    anc = [(436222, 436222)]
    old = vocab(spark, old_c, anc, maps(src, 436222))
    new = vocab(spark, new_c, anc, maps(src, 436222))
    counts = df(spark, [(src, 88528142, 88528142)], COUNTS)
    out = vocabulary_change_report(items, old, new, counts, included_source_vocabs=["ICD10CM"])["domain_change"]
    assert rows(out) == [
        (
            123, "Altered mental status", "Altered mental status", 1, 436222, "Altered mental status", "SNOMED",
            "R41.82", "Altered mental status, unspecified", "ICD10CM", "Condition", "Observation", 88528142,
        )
    ]
