"""Enrichment of records from a key/value table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.functions import Expression, as_text
from brooklet.operators.fields import require_absent
from brooklet.operators.hotkeys import GROUP_ROWS, find_hot_keys
from brooklet.operators.names import fields
from brooklet.sources.lookup import unique_keys

_SEARCH = "__search"


def enrich(
    df: DataFrame, lookup: DataFrame, name: str, search_key: Expression, group_rows: int | None = GROUP_ROWS
) -> DataFrame:
    """Add text field ``name``: the value stored under ``str(search_key)``, or ``''`` where there is none.

    ``lookup`` has text columns ``key`` and ``value``.  Unless it comes from
    ``sources.lookup_table`` its keys are checked here: a repeated key fails the
    query instead of multiplying records.  A streaming ``df`` makes this a stateless
    stream-static join.

    A lookup below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast by Spark
    and nothing is shuffled.  A larger one is shuffled; then search keys above
    ``group_rows`` rows are joined apart, since their few entries can be
    broadcast (``None`` leaves that out).
    """
    return with_lookup(df, lookup, name, search_key, group_rows).drop(hit_column(name))


def hit_column(name: str) -> str:
    return f"{name}__hit"


def with_lookup(
    df: DataFrame, lookup: DataFrame, name: str, search_key: Expression, group_rows: int | None = GROUP_ROWS
) -> DataFrame:
    """``enrich`` plus a boolean column that tells hits from misses."""
    require_absent(df, name)
    table = unique_keys(lookup).select(F.col("key").alias("__key"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    keyed = df.withColumn(_SEARCH, as_text(df, search_key))
    hot = None
    if not df.isStreaming and not _is_small(table):
        hot = find_hot_keys(keyed.select(_SEARCH), group_rows)
    if hot is None:
        joined = _left_join(keyed, table)
    else:
        # One entry per hot key at most, so this side is as bounded as the list of hot keys.
        few = F.broadcast(hot.only(table, "__key"))
        joined = _left_join(hot.without(keyed, _SEARCH), table).unionAll(_left_join(hot.only(keyed, _SEARCH), few))
    return joined.select(
        *fields(df),
        F.coalesce(F.col("__value"), F.lit("")).alias(name),
        F.coalesce(F.col("__hit"), F.lit(False)).alias(hit_column(name)),
    )


def _left_join(records: DataFrame, table: DataFrame) -> DataFrame:
    return records.join(table, F.col(_SEARCH) == F.col("__key"), "left")


def _is_small(table: DataFrame) -> bool:
    """Does the optimizer's size estimate allow a broadcast?"""
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit
