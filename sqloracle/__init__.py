"""DuckDB oracle SQL for the registered queries (fixture CTEs + one statement per query)."""
