"""One-to-one pairing of two unbounded streams: one waiting row per key as state."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.streaming.held import Arrays
from brooklet.streaming.resume import KeptState
from brooklet.streaming.rows import check_order, keyed_state, pack, unpack


def pair_rows_stream(
    first: DataFrame,
    second: DataFrame,
    first_key: str,
    second_key: str,
    ttl: float,
    ts: str,
    tiebreak: Sequence[str],
    lateness: str | None = None,
    ordered: bool = False,
    state: KeptState | None = None,
) -> DataFrame:
    """Streaming form of ``operators.pairing.pair_rows``; see ``dedup_stream`` on ``lateness``, ``ordered`` and ``state``."""
    span = round(ttl * 1_000_000)

    def pair(rows: Arrays, waiting: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
        """The closed form of the batch operator; the row that waits comes before all others."""
        side, t, payload = (rows[name] for name in ("side", "t", "payload"))
        if waiting is not None:
            side, t, payload = (np.concatenate([[old], new]) for old, new in zip(waiting, (side, t, payload.astype(object))))
        if not len(side):
            return None, waiting
        side, t = side.astype(np.int64), t.astype(np.int64)
        linked = np.zeros(len(side), dtype=bool)
        linked[1:] = (side[1:] != side[:-1]) & (t[1:] - t[:-1] <= span)
        place = np.arange(len(side))
        closing = linked & ((place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 1)
        left = None if closing[-1] else (int(side[-1]), int(t[-1]), payload[-1])
        later = np.flatnonzero(closing)
        if not len(later):
            return None, left
        ours = np.where(side[later] == 0, later, later - 1)
        theirs = np.where(side[later] == 0, later - 1, later)
        return pd.DataFrame({"first": payload[ours], "second": payload[theirs], "arrived": side[later]}), left

    check_order(first, tiebreak, lateness, ordered)
    packed = pack(first, first_key, ts, tiebreak, 0).unionByName(pack(second, second_key, ts, tiebreak, 1))
    pairs = keyed_state(
        packed, pair, "side int, t bigint, payload string", "first string, second string, arrived int",
        lambda waiting: waiting[1] + span, lateness, ordered, kept=state,
    )
    return pairs.select(
        unpack("first", first.schema).alias("first"), unpack("second", second.schema).alias("second"), F.col("arrived")
    )
