"""Plans: size-checked broadcast, the report builders and the registered query catalog."""
