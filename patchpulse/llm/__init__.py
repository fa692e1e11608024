"""Operators for preparing training data: extraction, duplicates, quality, safety, mixing and sharding."""
