"""Operators of a training-data pipeline: filters, joins, packing, search, archives, dedup, models."""
