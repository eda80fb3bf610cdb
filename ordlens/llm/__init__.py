"""Training-data operators: dedup, search, filtering, packing, extraction, encoding, sharding."""
