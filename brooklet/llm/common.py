"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brooklet.operators.hotkeys import in_ranges
from brooklet.session import shared_dir, work_path

# ASCII white space, as the text rules of the operators count it: blank and \t \n \v \f \r.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``wanted`` (new name = present name), found by exact name.

    Other columns are left out, so they may be called anything: like a result
    column, or like a wanted column but for upper and lower case.
    """
    missing = [name for name in wanted.values() if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    numbered = df.toDF(*[f"_{place}" for place in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{df.columns.index(name)}").alias(new) for new, name in wanted.items()])


def land(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; later steps and retries read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, which is removed when the session's JVM ends."""
    path = work_path(spark, label)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; texts without other letters take the quick way."""
    plain = F.char_length(text) == F.octet_length(text)
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(slow)


def text_tag(text: Column) -> Column:
    """With the document id, tells the rows of a table apart (rows equal in both are the same document)."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit("tag"))


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with the position (from 0) of each row in ``order`` as ``name``, without one task seeing all rows.

    Rows are cut into ranges; a range's rows are numbered in its own task, and
    the sizes of the ranges (one number each) say where it starts.
    """
    blocks = in_ranges(df, partitions(df.sparkSession), *order)
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1
    placed = blocks.withColumn("_inside", inside).join(F.broadcast(starts), "block")  # one row per partition
    return placed.withColumn(name, F.col("_start") + F.col("_inside")).drop("block", "_start", "_inside")
