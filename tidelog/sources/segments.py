"""Segments: one commit's immutable Parquet files, under commit=NAME/segment_id=N/bucket=B.

NAME is drawn anew for each attempt, so two writers that take the same number never share a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import KEY, SEGMENT, TOMBSTONE, VERSION

BUCKET, COMMIT = "bucket", "commit"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def place(segment: dict) -> str:
    """The folder of a segment of the manifest, below that of all segments."""
    return f"{COMMIT}={segment['commit']}/{SEGMENT}={segment['id']}"


def write_segment(rows: DataFrame, folder: str, segment_id: int, buckets: int, max_rows_per_file: int = 0) -> None:
    """Rows by bucket, each bucket's sorted by key and falling version, so that row groups can be skipped.

    Fails if the folder has the segment already.
    """
    rows = rows.drop(SEGMENT).withColumn(BUCKET, bucket_of(F.col(KEY), buckets))
    dealt = rows.repartition(buckets, BUCKET) if buckets > 1 else rows
    ordered = dealt.sortWithinPartitions(BUCKET, KEY, F.desc(VERSION), F.desc(TOMBSTONE))
    ordered.write.option("maxRecordsPerFile", max_rows_per_file).partitionBy(BUCKET).parquet(f"{folder}/{SEGMENT}={segment_id}")


def read_segments(spark: SparkSession, folder: str, segments: list[dict], schema: T.StructType) -> DataFrame:
    """The rows of segments ({"id", "commit"}) as one log, with segment_id and bucket."""
    full = T.StructType([*schema.fields, T.StructField(SEGMENT, T.IntegerType()), T.StructField(BUCKET, T.IntegerType())])
    if not segments:
        return spark.createDataFrame([], full)
    found = spark.read.schema(full).option("basePath", folder).parquet(*[f"{folder}/{place(s)}" for s in segments])
    return found.drop(COMMIT)
