"""Training-data operators: language ID, toxicity, top-k search, PII, near duplicates, resharding,
secret scans, subword encoding, decontamination and HTML main text.

Nothing else in the library imports this subpackage.
"""
