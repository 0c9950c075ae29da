"""Operators for training-data corpora: packing, decontamination, dedup, filtering, extraction and sharding."""
