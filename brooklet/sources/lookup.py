"""Key/value tables for enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.functions import Expression, as_text, to_column


# Marks the key column of a table made here.
_UNIQUE = {"brooklet.unique": True}


def has_unique_keys(table: DataFrame) -> bool:
    return table.schema["key"].metadata.get("brooklet.unique", False)


def lookup_table(df: DataFrame, key: Expression, value: Expression, version: Expression | None = None) -> DataFrame:
    """Text columns ``key`` and ``value`` with one row per key.

    With ``version`` the entry with the greatest version wins, as if the entries
    had been set one after the other.  Without it a repeated key fails the query
    that reads the table, since it would multiply records.
    """
    pairs = df.select(
        as_text(df, key).alias("key"),
        to_column(value).alias("value"),
        (F.lit(0) if version is None else to_column(version)).alias("version"),
    )
    # Values become text after the grouping: plain numbers are cheaper to aggregate.
    if version is not None:
        found = pairs.groupBy("key").agg(F.max_by("value", "version").alias("value"))
        return found.select(F.col("key").alias("key", metadata=_UNIQUE), as_text(found, "value").alias("value"))
    # The grouping also leaves a large table partitioned by key, as the join needs it.
    found = pairs.groupBy("key").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    text = as_text(found, "value")
    value = F.when(F.col("n") == 1, text).otherwise(_repeated())
    return found.select(F.col("key").alias("key", metadata=_UNIQUE), value.alias("value"))


def unique_keys(table: DataFrame) -> DataFrame:
    """``table`` (key, value) itself, but a repeated key fails the query that reads it."""
    if has_unique_keys(table):
        return table
    found = table.groupBy("key").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return found.select("key", F.when(F.col("n") == 1, F.col("value")).otherwise(_repeated()).alias("value"))


def _repeated() -> Column:
    return F.raise_error(F.concat(F.lit("lookup key occurs more than once: "), F.col("key"))).cast("string")
