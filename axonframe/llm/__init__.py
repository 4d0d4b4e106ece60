"""Training-data operators: deduplication, quality, scoring, mixing, privacy, archives.

Nothing else in ``axonframe`` imports this subpackage.
"""
