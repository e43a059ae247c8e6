"""Streaming enrichment from a stream of changes: the last change per key as state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.functions import Expression, as_text
from brooklet.operators.names import fields
from brooklet.operators.times import with_times
from brooklet.streaming.held import Arrays
from brooklet.streaming.rows import check_order, keyed_state, pack, unpack

_SEARCH = "__search"


def enrich_as_of_stream(
    df: DataFrame, changes: DataFrame, name: str, search_key: Expression, ts: str, lateness: str | None, ordered: bool
) -> DataFrame:
    """Streaming form of ``operators.asof.enrich_as_of``.

    Rows are put in order within each micro-batch; a record that comes after a
    later change of its key sees that one, unless ``ordered`` waits for the
    watermark.  A key's last change is kept for good.
    """

    def carry(rows: Arrays, known: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
        side, payload = rows["side"], rows["payload"]
        if not len(side):
            return None, known
        last = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), -1))
        change = payload[last]
        change[last < 0] = None if known is None else known[0]
        ours = side == 1
        found = pd.DataFrame({"payload": payload[ours], "change": change[ours]}) if ours.any() else None
        return found, known if last[-1] < 0 else (payload[last[-1]],)

    check_order(df, [], lateness, ordered)
    keyed = with_times(df, ts).withColumn(_SEARCH, as_text(df, search_key))
    packed = pack(keyed, _SEARCH, ts, [], 1).unionByName(pack(changes, "key", ts, [], 0))
    found = keyed_state(packed, carry, "change string", "payload string, change string", lambda known: None, lateness, ordered)
    rows = found.select(unpack("payload", keyed.schema).alias("row"), unpack("change", changes.schema)["value"].alias("__value"))
    rows = rows.select("row.*", "__value")
    return rows.select(*fields(df), F.coalesce("__value", F.lit("")).alias(name))
