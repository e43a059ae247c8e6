"""Finding keys that are too large for one task.

The keyed operators order the rows of a key.  Keys of ordinary size are handled
by one shuffle on the key.  A key above ``group_rows`` rows takes another way:
its narrow (key, time) columns are range-partitioned, so that one key spreads
over many tasks, and neighbouring ranges exchange one small row per border.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.operators.names import field, quoted
from brooklet.session import shared_dir

# Rows of one key that a single task may sort; a few hundred MB of narrow rows.
GROUP_ROWS = 5_000_000

# The list of hot keys comes to the driver; one longer than this means that group_rows is far too small.
MAX_HOT_KEYS = 1_000_000

_HOT = "hot_key"


@dataclass(frozen=True)
class HotKeys:
    """The hot keys as a small table, and how many rows they hold together."""

    table: DataFrame
    rows: int
    group_rows: int

    def only(self, df: DataFrame, key: str) -> DataFrame:
        return self._match(df, key, "left_semi")

    def without(self, df: DataFrame, key: str) -> DataFrame:
        return self._match(df, key, "left_anti")

    def _match(self, df: DataFrame, key: str, how: str) -> DataFrame:
        # At most rows / group_rows entries, see find_hot_keys.
        return df.join(F.broadcast(self.table), df[quoted(key)].eqNullSafe(self.table[_HOT]), how)

    def ranges(self, rows_per_hot_row: int = 1) -> int:
        """Number of range partitions that keeps each near ``group_rows`` rows."""
        return max(2, math.ceil(self.rows * rows_per_hot_row / self.group_rows))


def find_hot_keys(keys: DataFrame, group_rows: int | None) -> HotKeys | None:
    """Keys of the one-column table ``keys`` with more than ``group_rows`` rows.

    Runs one job that reads the key column only and counts map-side first.  The
    answer has fewer than total rows / group_rows entries, which bounds what
    comes to the driver and what is broadcast later.  ``None`` for
    ``group_rows`` skips the job: the caller knows that no key is that large.
    """
    if group_rows is None:
        return None
    name = keys.columns[0]
    counts = keys.groupBy(field(name).alias(_HOT)).agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") > group_rows).limit(MAX_HOT_KEYS + 1).collect()
    if len(found) > MAX_HOT_KEYS:
        raise ValueError(f"more than {MAX_HOT_KEYS} keys have over {group_rows} rows; raise group_rows")
    if not found:
        return None
    schema = T.StructType([T.StructField(_HOT, keys.schema[name].dataType)])
    table = keys.sparkSession.createDataFrame([(row[_HOT],) for row in found], schema)
    return HotKeys(table, sum(row["n"] for row in found), group_rows)


def in_ranges(df: DataFrame, ranges: int, *order: str | Column) -> DataFrame:
    """``df`` cut into contiguous ranges of ``order``, each a sorted partition; column ``block`` numbers them in that order.

    The cut points come from a sample, so the result is written to the
    checkpoint folder: every later step, and every retry after a lost executor,
    sees the same ranges.
    """
    shared_dir(df.sparkSession)
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return rows.withColumn("block", F.spark_partition_id()).checkpoint()
