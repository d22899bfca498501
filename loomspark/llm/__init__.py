"""Training-data operators: deduplication, tokenizing, packing, privacy, quality and media columns."""
