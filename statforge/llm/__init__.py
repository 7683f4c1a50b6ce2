"""Training-data operators: deduplication, quality, mixing, tokenising, archives and search."""
