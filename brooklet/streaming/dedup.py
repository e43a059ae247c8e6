"""Deduplication of an unbounded stream: one anchor time per key as state."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from brooklet.streaming.held import Arrays
from brooklet.streaming.resume import KeptState
from brooklet.streaming.rows import check_order, keyed_state, pack, unpack


def dedup_stream(
    df: DataFrame,
    key: str,
    ttl: float,
    ts: str,
    tiebreak: Sequence[str],
    lateness: str | None = None,
    ordered: bool = False,
    state: KeptState | None = None,
) -> DataFrame:
    """Streaming form of ``operators.dedup`` (batch); rows are put in order within each micro-batch.

    Without ``lateness`` no row is ever late, and one time per key is kept for
    good.  With it, an anchor is dropped once the watermark is past anchor + ttl.
    That changes no result: a row accepted after that is later than the anchor
    allows anyway.  Rows behind the watermark are dropped by Spark, so
    ``lateness`` must cover the disorder of the source.  ``ordered`` also holds
    rows back until the watermark has passed them: the result is then that of
    the batch form, whatever the order of arrival within ``lateness``.
    ``state`` is that of a stopped query to go on from (``resume.kept_state``).
    """
    span = round(ttl * 1_000_000)

    def keep(rows: Arrays, anchor: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
        times, kept = rows["t"].tolist(), []
        place = 0 if anchor is None else bisect_right(times, anchor[0] + span)
        while place < len(times):
            kept.append(place)
            anchor = (times[place],)
            place = bisect_right(times, anchor[0] + span, place + 1)
        return pd.DataFrame({"payload": rows["payload"][kept]}) if kept else None, anchor

    def still_open(times: np.ndarray, anchor: tuple) -> np.ndarray:
        return times > anchor[0] + span

    check_order(df, tiebreak, lateness, ordered)
    kept = keyed_state(
        pack(df, key, ts, tiebreak, 0), keep, "anchor bigint", "payload string",
        lambda anchor: anchor[0] + span, lateness, ordered, still_open, state,
    )
    return kept.select(unpack("payload", df.schema).alias("row")).select("row.*")
