"""Training-data operators: scans, filters, duplicates, sharding, tokenizing."""
