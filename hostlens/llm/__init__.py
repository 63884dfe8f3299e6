"""Training-data operators: mixing, sharding, quality, PII, decontamination, tokens, dedup, URLs, WARC."""
