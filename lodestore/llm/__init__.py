"""Training-data operators: counting, sharding, scanning, deduplication, scoring and mixing.

Nothing outside this subpackage imports it.
"""
