"""Training-data operators: packing, deduplication, language, quality, licences, sharding, counts, decontamination."""
