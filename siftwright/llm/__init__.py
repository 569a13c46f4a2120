"""Training-data operators: language ID, fingerprints, decontamination, secrets, toxicity, packing, PII and dedup."""
