"""Operators of a training-data pipeline: encoding, sharding, filters, near duplicates, packing."""
