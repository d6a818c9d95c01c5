"""Operators of a training-data pipeline: tokenizing, near-duplicates, rules, classifiers, packing, fingerprints."""
