"""The rows of a versioned log: key, version, tombstone and the payload's own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, VERSION, TOMBSTONE, VALUE, SEGMENT = "key", "version", "tombstone", "value", "segment_id"
#: Bytes of an entry besides its key and value: lengths, packed version and checksum.
ENTRY_OVERHEAD = 18
MAX_KEY_BYTES = 65535


def log_schema(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    return T.StructType([
        T.StructField(KEY, key or T.BinaryType()), T.StructField(VERSION, T.LongType()),
        T.StructField(TOMBSTONE, T.BooleanType()), T.StructField(VALUE, value or T.BinaryType()),
    ])


def valid_key(key: Column) -> Column:
    """True for keys of 1 to 65535 bytes; a null key isn't valid."""
    return F.coalesce(F.octet_length(key.cast("string")).between(1, MAX_KEY_BYTES), F.lit(False))


def payload(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in (KEY, VERSION, TOMBSTONE, SEGMENT)]


def as_log(df: DataFrame, key: Column, version: Column, tombstone: Column, *payload_cols: str) -> DataFrame:
    """A table seen as a log; keys keep their own type, so that filters on them reach the files."""
    return df.select(key.alias(KEY), version.cast("long").alias(VERSION), tombstone.alias(TOMBSTONE), *payload_cols)
