"""Operators: resolution, source-code difference, mappings, non-standard nodes, domain change, stats."""
