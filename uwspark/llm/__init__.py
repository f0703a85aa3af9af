"""Training-data operators: deduplication, filtering, sharding, decontamination, tokenisation."""
