"""Sinks: one written table per report."""
