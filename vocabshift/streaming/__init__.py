"""Streaming: incremental person flags over event files that keep arriving."""
