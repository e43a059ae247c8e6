"""One-to-one pairing of two record streams on a key, within a time limit.

Per key and in time order, at most one unmatched row waits.  An arriving row is
paired with the waiting row when that one is from the other side and at most
``ttl`` seconds older; both are then used up.  Otherwise the arriving row takes
the waiting place.  Unpaired rows vanish, so this is not a many-to-many
interval join.

Closed form used here: the waiting row is always the row just before.  Call a
row *linked* when the row before it is from the other side and not older than
the limit.  Within a run of linked rows, every second row closes a pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.operators.fields import require_present
from brooklet.operators.hotkeys import GROUP_ROWS, HotKeys, find_hot_keys, in_ranges
from brooklet.operators.names import field, fields, present_name, total_order
from brooklet.operators.times import plus_seconds, require_seconds, require_timestamp, with_times

if TYPE_CHECKING:
    from brooklet.streaming.resume import KeptState

FIRST, SECOND = 0, 1


def pair_join(
    first: DataFrame,
    second: DataFrame,
    first_key: str,
    second_key: str,
    ttl: float,
    ts: str = "ts",
    tiebreak: Sequence[str] = (),
    group_rows: int | None = GROUP_ROWS,
    lateness: str | None = None,
    ordered: bool = False,
    state: KeptState | None = None,
) -> DataFrame:
    """Pairs of ``first`` (the main side) and ``second`` rows with equal keys.

    The result has the fields of both sides; on equal names the main side wins,
    also where they differ in case and the session does not.  ``ts`` and the
    ``tiebreak`` columns exist on both sides; rows are taken in order of time,
    then main side first, then ``tiebreak``, then by a hash of the whole row.  A
    row without time fails the query.  ``state`` is that of a stopped stream to
    go on from (``streaming.resume``).
    """
    pairs = pair_rows(first, second, first_key, second_key, ttl, ts, tiebreak, group_rows, lateness, ordered, state)
    theirs = [F.col("second").getField(name).alias(name) for name in second.columns if present_name(first, name) is None]
    return pairs.select("first.*", *theirs)


def pair_rows(
    first: DataFrame,
    second: DataFrame,
    first_key: str,
    second_key: str,
    ttl: float,
    ts: str = "ts",
    tiebreak: Sequence[str] = (),
    group_rows: int | None = GROUP_ROWS,
    lateness: str | None = None,
    ordered: bool = False,
    state: KeptState | None = None,
) -> DataFrame:
    """Like ``pair_join``, with the two rows as structs ``first`` and ``second``.

    ``arrived`` tells which side came later (0 main, 1 second).
    """
    require_present(first, first_key, ts, *tiebreak)
    require_present(second, second_key, ts, *tiebreak)
    require_seconds(ttl)
    _require_same_types(first, second, first_key, second_key, ts, tiebreak)
    first, second = with_times(first, ts), with_times(second, ts)
    if first.isStreaming or second.isStreaming:
        from brooklet.streaming.pairing import pair_rows_stream

        return pair_rows_stream(first, second, first_key, second_key, ttl, ts, tiebreak, lateness, ordered, state)
    if state is not None:
        raise ValueError("only a stream can go on from the state of another one")
    keys = first.select(field(first_key).alias("k")).unionAll(second.select(field(second_key).alias("k")))
    hot = find_hot_keys(keys, group_rows)
    if hot is None:
        return _pair_by_key(first, second, first_key, second_key, ttl, ts, tiebreak)
    return _pair_by_key(
        hot.without(first, first_key), hot.without(second, second_key), first_key, second_key, ttl, ts, tiebreak
    ).unionByName(
        _pair_in_ranges(
            hot, hot.only(first, first_key), hot.only(second, second_key), first_key, second_key, ttl, ts, tiebreak
        )
    )


def _require_same_types(
    first: DataFrame, second: DataFrame, first_key: str, second_key: str, ts: str, tiebreak: Sequence[str]
) -> None:
    require_timestamp(first, ts)
    for ours, theirs in [(first_key, second_key), (ts, ts), *[(name, name) for name in tiebreak]]:
        if first.schema[ours].dataType != second.schema[theirs].dataType:
            raise ValueError(
                f"{ours!r} and {theirs!r} differ in type: {first.schema[ours].dataType.simpleString()}"
                f" and {second.schema[theirs].dataType.simpleString()}"
            )


def _row(df: DataFrame) -> Column:
    return F.struct(*fields(df))


def _order(df: DataFrame, key: str, ts: str, tiebreak: Sequence[str], side: int) -> list[Column]:
    """The four ordering columns: key, time, side and tie; only copies of a row are equal in all."""
    tie = F.struct(*[column.alias(f"tie{place}") for place, column in enumerate(total_order(df, tiebreak))])
    return [field(key).alias("k"), field(ts).alias("t"), F.lit(side).alias("side"), tie.alias("tie")]


def _linked(t_before: Column, side_before: Column, kind: T.DataType, ttl: float) -> Column:
    """Is the row before from the other side and recent enough?"""
    limit = plus_seconds(t_before, kind, ttl)
    return F.coalesce((side_before != F.col("side")) & (F.col("t") <= limit), F.lit(False))


# --- keys that fit one task: one shuffle and one sort; every window shares both


def _pair_by_key(
    first: DataFrame, second: DataFrame, first_key: str, second_key: str, ttl: float, ts: str, tiebreak: Sequence[str]
) -> DataFrame:
    nothing = F.lit(None)
    first_type, second_type = first.select(_row(first)).schema[0].dataType, second.select(_row(second)).schema[0].dataType
    rows = first.select(
        *_order(first, first_key, ts, tiebreak, FIRST), _row(first).alias("first"), nothing.cast(second_type).alias("second")
    ).unionAll(
        second.select(
            *_order(second, second_key, ts, tiebreak, SECOND), nothing.cast(first_type).alias("first"), _row(second).alias("second")
        )
    )
    by_key = Window.partitionBy("k").orderBy("t", "side", "tie")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Plain columns inside lag(): a struct would be built, and shuffled, a second time.
    before = {f"{name}_before": F.lag(name).over(by_key) for name in ("t", "side", "first", "second")}
    placed = (
        rows.withColumns(before)
        .withColumn("position", F.row_number().over(by_key))
        .withColumn("linked", _linked(F.col("t_before"), F.col("side_before"), first.schema[ts].dataType, ttl))
        .withColumn("run_start", F.max(F.when(~F.col("linked"), F.col("position"))).over(so_far))
    )
    return placed.filter(F.col("linked") & ((F.col("position") - F.col("run_start")) % 2 == 1)).select(
        F.coalesce("first", "first_before").alias("first"),
        F.coalesce("second", "second_before").alias("second"),
        F.col("side").alias("arrived"),
    )


# --- hot keys: pairs are found on narrow ranges, the rows are fetched at the end


def _pair_in_ranges(
    hot: HotKeys,
    first: DataFrame,
    second: DataFrame,
    first_key: str,
    second_key: str,
    ttl: float,
    ts: str,
    tiebreak: Sequence[str],
) -> DataFrame:
    # Of the rows of one side at one instant, only the first can close a pair and only the last can
    # wait; the others replace each other.  This is combined map-side.  Copies of a row are numbered.
    sides = first.select(*_order(first, first_key, ts, tiebreak, FIRST)).unionAll(
        second.select(*_order(second, second_key, ts, tiebreak, SECOND))
    )
    copies = sides.groupBy("k", "t", "side", "tie").agg(F.count(F.lit(1)).alias("n"))
    low, high = F.struct("tie", F.lit(0).cast("bigint").alias("copy")), F.struct("tie", (F.col("n") - 1).alias("copy"))
    ends = copies.groupBy("k", "t", "side").agg(F.min(low).alias("low"), F.max(high).alias("high"))
    rows = ends.select("k", "t", "side", F.explode(F.array_distinct(F.array("low", "high"))).alias("end"))
    rows = rows.select("k", "t", "side", "end.tie", "end.copy")
    blocks = in_ranges(rows, hot.ranges(), "k", "t", "side", "tie", "copy")

    in_block = Window.partitionBy("block", "k").orderBy("t", "side", "tie", "copy")
    blocks = blocks.withColumn("position", F.row_number().over(in_block)).withColumn(
        "before", F.lag(F.struct("t", "side", "tie")).over(in_block)
    )
    # Borders: the row before each (key, block), and the number of rows ahead of it.
    earlier = Window.partitionBy("k").orderBy("block")
    borders = blocks.groupBy("k", "block").agg(
        F.max_by(F.struct("t", "side", "tie"), F.struct("t", "side", "tie", "copy")).alias("tail"), F.count(F.lit(1)).alias("n")
    )
    borders = borders.select(
        "k",
        "block",
        F.lag("tail").over(earlier).alias("tail_before"),
        F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    placed = _with_border(blocks, borders)
    placed = (
        placed.withColumn("before", F.coalesce("before", "tail_before"))
        .withColumn("position", F.col("position") + F.col("ahead"))
        .withColumn("linked", _linked(F.col("before.t"), F.col("before.side"), first.schema[ts].dataType, ttl))
        .drop("tail_before", "ahead")
    )
    # A run of linked rows may have begun in an earlier block.
    starts = placed.groupBy("k", "block").agg(F.max(F.when(~F.col("linked"), F.col("position"))).alias("start"))
    starts = starts.select(
        "k", "block", F.max("start").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("start_before")
    )
    own_start = F.max(F.when(~F.col("linked"), F.col("position"))).over(
        in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = _with_border(placed.withColumn("run_start", own_start), starts).withColumn(
        "run_start", F.coalesce("run_start", "start_before")
    )
    arrived, waited = F.struct("t", "tie"), F.struct("before.t", "before.tie")
    is_first = F.col("side") == FIRST
    pairs = placed.filter(F.col("linked") & ((F.col("position") - F.col("run_start")) % 2 == 1)).select(
        "k",
        F.col("side").alias("arrived"),
        F.when(is_first, arrived).otherwise(waited).alias("first_at"),
        F.when(is_first, waited).otherwise(arrived).alias("second_at"),
    )

    # Each row is in at most one pair, so these joins spread evenly; of copies any one will do.
    def rows_of(df: DataFrame, key: str, side: int, name: str) -> DataFrame:
        k, t, _, tie = _order(df, key, ts, tiebreak, side)
        rows = df.select(k.alias(f"{name}_k"), F.struct(t, tie).alias(f"{name}_id"), _row(df).alias(name))
        return rows.dropDuplicates([f"{name}_k", f"{name}_id"])

    ours, theirs = rows_of(first, first_key, FIRST, "first"), rows_of(second, second_key, SECOND, "second")
    return (
        pairs.join(ours, F.col("k").eqNullSafe(F.col("first_k")) & (F.col("first_at") == F.col("first_id")))
        .join(theirs, F.col("k").eqNullSafe(F.col("second_k")) & (F.col("second_at") == F.col("second_id")))
        .select("first", "second", "arrived")
    )


def _with_border(rows: DataFrame, borders: DataFrame) -> DataFrame:
    borders = borders.withColumnsRenamed({"k": "border_k", "block": "border_block"})
    on = F.col("k").eqNullSafe(F.col("border_k")) & (F.col("block") == F.col("border_block"))
    # At most one row per range and hot key.
    return rows.join(F.broadcast(borders), on).drop("border_k", "border_block")
