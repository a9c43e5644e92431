"""Operators for building training data: tokenisers, duplicates, classifiers, mixing, sharding."""
