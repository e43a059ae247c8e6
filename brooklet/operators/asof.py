"""Enrichment from a changelog: every record sees the value its key had at the record's time.

Changes and records are put in one order per key (a change comes before records
of the same time), and the last value is carried forward: one shuffle, one sort,
one pass.  Keys above ``group_rows`` rows are cut into ranges of time; a range
gets the last value of the ranges before it, one small row per range and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brooklet.functions import Expression, as_text
from brooklet.operators.fields import require_absent, require_present
from brooklet.operators.hotkeys import GROUP_ROWS, find_hot_keys, in_ranges
from brooklet.operators.names import fields, total_order
from brooklet.operators.times import micros, require_timestamp, with_times

_SEARCH = "__search"


def enrich_as_of(
    df: DataFrame,
    changes: DataFrame,
    name: str,
    search_key: Expression,
    ts: str = "ts",
    group_rows: int | None = GROUP_ROWS,
    lateness: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Add text field ``name``: the value ``str(search_key)`` had at the record's time, or ``''``.

    ``changes`` has text columns ``key`` and ``value`` and the time ``ts``, as
    ``df`` has.  A change counts from its own time on; a null value takes the
    key away.  Of changes with equal key and time the last by a hash of the row
    counts, in batches and in streams alike; changes without key count for
    nothing.  Rows without time fail the query.  Two streams keep the last
    change per key as state (see ``streaming.asof``); ``lateness`` and
    ``ordered`` are those of ``dedup``.
    """
    require_absent(df, name)
    require_present(df, ts)
    require_present(changes, "key", "value", ts)
    for side in (df, changes):
        require_timestamp(side, ts)
    if df.isStreaming != changes.isStreaming:
        raise ValueError("records and changes must both be batches or both be streams")
    changes = changes.select("key", "value", ts).filter("key is not null")
    if df.isStreaming:
        from brooklet.streaming.asof import enrich_as_of_stream

        return enrich_as_of_stream(df, with_times(changes, ts), name, search_key, ts, lateness, ordered)
    entries = _entries(with_times(df, ts), with_times(changes, ts), search_key, ts)
    hot = find_hot_keys(entries.select("k"), group_rows)
    if hot is None:
        found = _carried(entries, ["k"])
    else:
        found = _carried(hot.without(entries, "k"), ["k"]).unionByName(_carried_in_ranges(hot.only(entries, "k"), hot.ranges()))
    records = found.filter("side = 1").select("row.*", F.col("change.value").alias("__value"))
    return records.select(*fields(df), F.coalesce("__value", F.lit("")).alias(name))


def _entries(df: DataFrame, changes: DataFrame, search_key: Expression, ts: str) -> DataFrame:
    """Columns k, t, side (0: change), change, row."""
    keyed = df.withColumn(_SEARCH, as_text(df, search_key))
    # One change per key and time, combined map-side.
    last = changes.groupBy(F.col("key").alias("k"), micros(changes, ts).alias("t")).agg(
        F.max_by(F.struct("value"), F.struct(*total_order(changes, []))).alias("change")
    )
    rows = keyed.select(
        F.col(_SEARCH).alias("k"), micros(df, ts).alias("t"), F.lit(1).alias("side"),
        F.lit(None).cast(last.schema["change"].dataType).alias("change"), F.struct(*fields(df)).alias("row"),
    )
    return rows.unionByName(last.select("k", "t", F.lit(0).alias("side"), "change", F.lit(None).cast(rows.schema["row"].dataType).alias("row")))


def _carried(entries: DataFrame, group: list[str]) -> DataFrame:
    order = Window.partitionBy(*group).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("change", F.last("change", ignorenulls=True).over(order))


def _carried_in_ranges(entries: DataFrame, ranges: int) -> DataFrame:
    blocks = in_ranges(entries.withColumn("place", F.monotonically_increasing_id()), ranges, "k", "t", "side", "place")
    is_change = F.col("side") == 0
    ends = blocks.groupBy("k", "block").agg(F.max_by(F.when(is_change, F.col("change")), F.when(is_change, F.col("t"))).alias("end"))
    before = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ends.select("k", "block", F.last("end", ignorenulls=True).over(before).alias("start"))
    inside = _carried(blocks, ["k", "block"]).join(starts, ["k", "block"])
    return inside.withColumn("change", F.coalesce("change", "start")).select("k", "t", "side", "change", "row")
