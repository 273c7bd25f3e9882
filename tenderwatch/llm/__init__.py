"""Training-data operators: packing, extraction, tokens, secrets, shards and deduplication."""
