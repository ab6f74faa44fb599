"""Schemas, limits and errors of the key-log engine."""

from __future__ import annotations

from pyspark.sql import types as T

INSERT, DELETE = 1, 2
MAX_KEY_BYTES = 1 << 20
MAX_TTL_NANOS = 200 * 365 * 24 * 3600 * 10**9

#: The mutation log: expires_at is in nanoseconds, 0 = never; seq orders mutations globally.
LOG = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("op", T.ByteType(), False), T.StructField("seq", T.LongType(), False), T.StructField("expires_at", T.LongType(), False)])


class KeyLogError(Exception):
    """Base of all errors of the engine."""


class EmptyKey(KeyLogError): ...


class KeyTooLarge(KeyLogError): ...


class InvalidTTL(KeyLogError): ...


class InvalidPattern(KeyLogError): ...


class StoreClosed(KeyLogError): ...


class ReadOnlyStore(KeyLogError): ...


class StalePlan(KeyLogError): ...


class CorruptStore(KeyLogError): ...
