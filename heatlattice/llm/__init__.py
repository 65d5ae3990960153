"""Training-data operators: deduplication, packing, identification, scoring and formatting of text."""
