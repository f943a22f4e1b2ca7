"""Training-data operators: extraction, scoring, tokenising, deduplication, search and layout.

Nothing else in the library imports this subpackage."""
