"""Training-data operators (quality, language, mixing, toxicity, WARC, personal data,
near duplicates, decontamination, sharding). Nothing else in the library imports this package."""
