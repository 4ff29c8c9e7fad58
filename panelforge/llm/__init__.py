"""Operations of a training-data pipeline: scoring, deduplication, filters, packing and sharding.

Nothing else in the library imports this subpackage.
"""
