"""Operators over training text: sharding, quality, deduplication, mixing, search, scoring and segmentation."""
