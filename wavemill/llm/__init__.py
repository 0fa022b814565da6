"""Training-data operators: deduplication, decontamination, quality, language, tokens, shards, licences, WARC."""
