"""Operators of a training-data pipeline: filtering, deduplication, scoring, packing, archiving.

Nothing outside this package imports it.
"""
