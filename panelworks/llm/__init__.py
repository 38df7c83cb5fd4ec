"""Training-data operators: packing, deduplication, quality rules, secret scans, token files, sharding, chat formatting."""
