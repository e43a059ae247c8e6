"""JSON files in an object store, one folder per value of a title field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.operators.names import field
from brooklet.sinks.topics import JSON_OPTIONS

BUCKET = "_bucket"


def bucketed(df: DataFrame, title: str | None) -> DataFrame:
    """``df`` in field order, with the title copied so that it also stays inside the record."""
    ordered = df.select(*map(field, sorted(df.columns)))
    return ordered if title is None else ordered.withColumn(BUCKET, field(title))


def write_buckets(
    df: DataFrame, path: str, title: str | None = None, rows_per_file: int = 0, mode: str = "append", gather: bool = False
) -> None:
    """Write a batch DataFrame below ``path``.

    ``rows_per_file=1`` gives one record per file; 0 sets no limit.  ``gather``
    brings equal titles together first, so that a title does not get one small
    file from every task; adaptive execution splits the titles that are large.
    """
    rows = bucketed(df, title)
    if gather and title is not None:
        rows = rows.hint("rebalance", BUCKET)
    writer = rows.write.format("json").options(**JSON_OPTIONS).option("maxRecordsPerFile", rows_per_file).mode(mode)
    (writer if title is None else writer.partitionBy(BUCKET)).save(path)


def bucket_stream(df: DataFrame, path: str, title: str | None = None, rows_per_file: int = 0, gather: bool = False):
    """Streaming writer for the same layout; each record is written exactly once.

    ``gather`` deals the records out by title first.  A title gets one file per
    micro-batch, or several from as many tasks where it is large: adaptive
    execution splits it by the bytes it has in that micro-batch.  Spark plans
    queries with state of their own without it; a hot title is then one task.
    """
    rows = bucketed(df, title)
    if gather and title is not None:
        rows = rows.hint("rebalance", BUCKET)
    writer = rows.writeStream.format("json").options(**JSON_OPTIONS)
    writer = writer.option("maxRecordsPerFile", rows_per_file).option("path", path)
    return writer if title is None else writer.partitionBy(BUCKET)


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records written by the two functions above, without the folder column."""
    return spark.read.schema(schema).options(**JSON_OPTIONS).json(path).drop(BUCKET)
