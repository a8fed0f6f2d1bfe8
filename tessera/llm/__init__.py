"""Corpus operators for training data: language, quality, personal data,
toxicity, near-duplicates, token files, sharding, packing and BPE."""
