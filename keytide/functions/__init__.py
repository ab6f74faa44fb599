"""Scalar functions on keys."""
