"""Training-data operators: mixing, deduplication, extraction, scoring and encoding of documents."""
