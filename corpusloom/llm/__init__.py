"""Training-data operators: dedup, search, extraction, sharding, mixing, packing."""
