"""Logical rewrites on the driver: patterns, file pruning, compaction plans."""
