"""Training-data operators: extraction, filtering, deduplication, search, tokens, packing."""
