"""Training-data operators: filters, deduplication, packing, scoring and search over text."""
