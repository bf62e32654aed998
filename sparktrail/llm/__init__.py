"""Training-data operators: packing, sharding, language, extraction, deduplication, search, tokens, toxicity."""
