"""Deduplication with an anchored time-to-live.

Per key, in time order: a row is kept when there is no anchor yet, or when it is
strictly later than anchor + ttl; a kept row becomes the anchor.  Suppressed rows
do not move the anchor, so this is neither ``dropDuplicates`` nor a session gap.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.operators.fields import require_present
from brooklet.operators.hotkeys import GROUP_ROWS, HotKeys, find_hot_keys, in_ranges
from brooklet.operators.names import field, fields, quoted, total_order
from brooklet.operators.times import micros, require_seconds, require_timestamp, with_times

if TYPE_CHECKING:
    from brooklet.streaming.resume import KeptState


def dedup(
    df: DataFrame,
    key: str,
    ttl: float,
    ts: str = "ts",
    tiebreak: Sequence[str] = (),
    group_rows: int | None = GROUP_ROWS,
    lateness: str | None = None,
    ordered: bool = False,
    state: KeptState | None = None,
) -> DataFrame:
    """Rows of ``df`` that survive a time-to-live of ``ttl`` seconds per ``key``.

    ``tiebreak`` orders rows with equal key and time; those it leaves equal are
    ordered by a hash of the whole row, so the result is always the same.  A row
    without time fails the query.  Batch input is first checked for keys above ``group_rows``
    rows (one small job; ``None`` skips it).  Streaming input keeps one anchor
    per key as state; ``lateness`` is the watermark delay after which anchors
    may expire, and ``ordered`` waits that long to undo disorder (see
    ``dedup_stream``).  ``state`` is that of a stopped stream to go on from
    (``streaming.resume``); batch input has none.
    """
    require_present(df, key, ts, *tiebreak)
    require_seconds(ttl)
    require_timestamp(df, ts)
    df = with_times(df, ts)
    if df.isStreaming:
        from brooklet.streaming.dedup import dedup_stream

        return dedup_stream(df, key, ttl, ts, tiebreak, lateness, ordered, state)
    if state is not None:
        raise ValueError("only a stream can go on from the state of another one")
    hot = find_hot_keys(df.select(field(key)), group_rows)
    if hot is None:
        return _scan_keys(df, key, ttl, ts, tiebreak)
    ordinary = _scan_keys(hot.without(df, key), key, ttl, ts, tiebreak)
    return ordinary.unionByName(_follow_chains(hot, hot.only(df, key), key, ttl, ts, tiebreak))


# --- keys that fit one task: one shuffle, one sort, one pass in constant memory


def _scan_keys(df: DataFrame, key: str, ttl: float, ts: str, tiebreak: Sequence[str]) -> DataFrame:
    ordered = df.repartition(field(key)).sortWithinPartitions(field(key), field(ts), *total_order(df, tiebreak))
    key_at, ts_at, span = df.columns.index(key), df.columns.index(ts), round(ttl * 1_000_000)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # (key, time of the last row, anchor) where the previous batch ended
        for batch in batches:
            if batch.num_rows:
                keep, state = keep_rows(batch.column(key_at), batch.column(ts_at), span, state)
                yield batch.filter(pa.array(keep))

    # The hand-over to Python takes plain names only.
    plain = ordered.toDF(*[f"c{place}" for place in range(len(df.columns))])
    return plain.mapInArrow(scan, plain.schema).toDF(*df.columns)


def keep_rows(keys: pa.Array, times: pa.Array, ttl: int, state: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows of a batch sorted by (key, time) are kept; ``state`` links it to the batch before."""
    t = times.cast(pa.int64()).to_numpy(zero_copy_only=False)
    size = len(t)
    # A stretch starts with a new key or after a silence longer than the ttl; its first row is always kept.
    start = np.empty(size, dtype=bool)
    same_key = state is not None and state[0] == keys[0].as_py()
    start[0] = not same_key or t[0] - state[1] > ttl
    if size > 1:
        here, before = keys.slice(1), keys.slice(0, size - 1)
        changed = pc.fill_null(pc.not_equal(here, before), pc.xor(pc.is_null(here), pc.is_null(before)))
        start[1:] = changed.to_numpy(zero_copy_only=False) | (np.diff(t) > ttl)
    keep = start.copy()
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], size)
    # Stretches no longer than the ttl hold one kept row; only the others are walked.
    long = t[ends - 1] - t[begins] > ttl
    walk = [(begin, end, t[begin]) for begin, end in zip(begins[long].tolist(), ends[long].tolist())]
    if not start[0]:
        walk.insert(0, (-1, int(begins[0]) if len(begins) else size, state[2]))
    anchor = t[begins[-1]] if len(begins) else state[2]
    if walk:
        values = t.tolist()
        for begin, end, anchor_here in walk:
            row = bisect_right(values, anchor_here + ttl, begin + 1, end)
            while row < end:
                keep[row] = True
                anchor_here = values[row]
                row = bisect_right(values, anchor_here + ttl, row + 1, end)
            if end == size:
                anchor = anchor_here
    return keep, (keys[size - 1].as_py(), int(t[-1]), int(anchor))


# --- hot keys: the kept times are found on narrow (key, time) ranges, the rows are fetched at the end


def _follow_chains(
    hot: HotKeys, df: DataFrame, key: str, ttl: float, ts: str, tiebreak: Sequence[str]
) -> DataFrame:
    times = df.select(field(key).alias("k"), micros(df, ts).alias("t")).distinct()
    kept = _anchors(hot, times, round(ttl * 1_000_000))
    rows = df.join(kept, df[quoted(key)].eqNullSafe(kept["k"]) & (micros(df, ts) == kept["t"]), "left_semi")
    # One row per kept (key, time): the first in the total order, combined map-side before the shuffle.
    first = F.min_by(F.struct(*fields(df)), F.struct(*total_order(df, tiebreak)))
    return rows.groupBy(field(key).alias("k"), field(ts).alias("t")).agg(first.alias("row")).select("row.*")


def _anchors(hot: HotKeys, times: DataFrame, ttl: int) -> DataFrame:
    """Anchor times (k, t) of the distinct ``times`` (k, t), in a number of passes that follows the digits of the number of ranges.

    Each time appears twice: as a row, and as the question "which row comes
    first after t + ttl?".  Sorted and cut into ranges, a range answers its
    questions and knows where a chain that enters it leaves it.  These links
    between ranges are followed by doubling, which tells where each range is
    entered; a last pass follows the chains inside the ranges.
    """
    entries = times.select("k", F.col("t").alias("at"), F.lit(0).alias("ask"), "t").unionByName(
        times.select("k", (F.col("t") + ttl).alias("at"), F.lit(1).alias("ask"), "t")
    )
    blocks = in_ranges(entries, hot.ranges(2), "k", "at", "ask")
    kind = times.schema["k"].dataType.simpleString()
    found = blocks.filter("ask = 0").groupBy("k", "block").agg(F.min("at").alias("head"), F.max("at").alias("tail"))
    borders: dict = defaultdict(list)
    for row in found.toArrow().to_pylist():  # ranges and hot keys bound these rows
        borders[repr(row["k"])].append((row["block"], row["head"], row["tail"]))
    for known in borders.values():
        known.sort()
    edges = blocks.mapInArrow(_edges(ttl, dict(borders)), f"k {kind}, at bigint, kind int, target bigint, known boolean").checkpoint()
    entered: dict = defaultdict(set)
    for row in _entered(edges).toArrow().to_pylist():  # a range is entered once per key at most
        entered[repr(row["k"])].add(row["at"])
    return blocks.mapInArrow(_kept_times(ttl, dict(borders), dict(entered)), f"k {kind}, t bigint")


@dataclass
class _Segment:
    """The rows and questions of one key in one range."""

    key: object
    rows: np.ndarray  # times, ascending
    after: np.ndarray  # place of the first row after each row's ttl; -1 where that is not in this range
    known: np.ndarray  # anchors whatever came before: rows after a silence longer than the ttl
    crossing: list[tuple[int, int | None]]  # (time, first row after its ttl) where the two are in different ranges
    entries: np.ndarray  # rows where a chain may come in


def _segments(batches: Iterable[pa.RecordBatch], ttl: int, borders: dict) -> Iterator[_Segment]:
    """The segments of a partition, which is one sorted range."""
    table = pa.Table.from_batches(list(batches)) if batches else None
    if table is None or not table.num_rows:
        return
    keys = table.column("k").combine_chunks()
    block = table.column("block")[0].as_py()
    changed = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False).to_numpy(zero_copy_only=False)
    nulls = pc.is_null(keys).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(changed | (nulls[1:] != nulls[:-1])) + 1
    at, ask, t = (table.column(name).to_numpy() for name in ("at", "ask", "t"))
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        key, is_row = keys[begin].as_py(), ask[begin:end] == 0
        rows, asked, source = at[begin:end][is_row], at[begin:end][~is_row], t[begin:end][~is_row]
        around = borders.get(repr(key), [])
        before = max((tail for place, _, tail in around if place < block), default=None)
        following = next((head for place, head, _ in around if place > block), None)
        answer = np.searchsorted(rows, asked, side="right")
        here = source >= rows[0] if len(rows) else np.zeros(len(source), dtype=bool)
        inside = answer < len(rows)
        after = np.full(len(rows), -1)
        after[np.searchsorted(rows, source[here & inside])] = answer[here & inside]
        crossing = [(int(x), int(rows[y])) for x, y in zip(source[~here & inside], answer[~here & inside])]
        crossing += [(int(x), following) for x in source[~inside]]
        known = np.diff(rows, prepend=rows[:1]) > ttl
        entries = known.copy()
        if len(rows):
            known[0] = before is None or rows[0] - before > ttl
            entries[answer[~here & inside]] = True
            entries[0] = True
        yield _Segment(key, rows, after, known, crossing, entries)


def _edges(ttl: int, borders: dict):
    """Where chains lead: from a range's entries to their last row in it (kind 0), and on to the next range (kind 1)."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        for part in _segments(batches, ttl, borders):
            last = np.where(part.after < 0, np.arange(len(part.rows)), part.after)
            while not np.array_equal(further := last[last], last):
                last = further
            come = np.flatnonzero(part.entries)
            leave = [(source, target) for source, target in part.crossing if target is not None]
            size = len(come) + len(leave)
            yield pa.record_batch(
                [
                    pa.array([part.key] * size, batches[0].schema.field("k").type),
                    pa.array([*part.rows[come].tolist(), *(source for source, _ in leave)], pa.int64()),
                    pa.array([0] * len(come) + [1] * len(leave), pa.int32()),
                    pa.array([*part.rows[last[come]].tolist(), *(target for _, target in leave)], pa.int64()),
                    pa.array([*part.known[come].tolist(), *[False] * len(leave)], pa.bool_()),
                ],
                ["k", "at", "kind", "target", "known"],
            )

    return emit


def _entered(edges: DataFrame) -> DataFrame:
    """The entries (k, at) that chains really take, other than those known before.

    From an entry a chain leads on to one entry of a later range.  These links
    are doubled: after n rounds they span 2^n ranges, and so do the entries that
    are reached.  All joins are on (key, time), so the links of one key spread
    over all tasks, and there are as many rounds as the number of ranges has
    binary digits.
    """
    arrive, leave = edges.filter("kind = 0"), edges.filter("kind = 1")
    same = F.col("a.k").eqNullSafe(F.col("b.k"))
    starts = arrive.filter("known").select("k", "at")
    onward = arrive.alias("a").join(leave.alias("b"), same & (F.col("a.target") == F.col("b.at"))).select("a.k", "a.at", F.col("b.target").alias("to"))
    # A chain need not be followed into a known entry: another one starts there.
    links = onward.alias("a").join(starts.alias("b"), same & (F.col("a.to") == F.col("b.at")), "left_anti").checkpoint()
    reached = starts.alias("a").join(links.alias("b"), same & (F.col("a.at") == F.col("b.at"))).select("b.k", F.col("b.to").alias("at")).checkpoint()
    while not links.isEmpty():
        further = reached.alias("a").join(links.alias("b"), same & (F.col("a.at") == F.col("b.at"))).select("b.k", F.col("b.to").alias("at"))
        reached = reached.unionByName(further).distinct().checkpoint()
        links = links.alias("a").join(links.alias("b"), same & (F.col("a.to") == F.col("b.at"))).select("a.k", "a.at", "b.to").checkpoint()
    return reached


def _kept_times(ttl: int, borders: dict, entered: dict):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        for part in _segments(batches, ttl, borders):
            kept = part.known.copy()
            taken = np.array(sorted(entered.get(repr(part.key), ())), dtype=np.int64)
            kept[np.isin(part.rows, taken)] = True
            front = np.flatnonzero(kept)
            while len(front):
                front = part.after[front]
                front = np.unique(front[front >= 0])
                front = front[~kept[front]]
                kept[front] = True
            times = part.rows[kept]
            yield pa.record_batch([pa.array([part.key] * len(times), batches[0].schema.field("k").type), pa.array(times, pa.int64())], ["k", "t"])

    return emit
