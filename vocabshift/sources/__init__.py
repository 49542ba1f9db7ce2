"""Sources: cohort-definition JSON and library items, vocabulary/event/pair tables, test fixtures."""
