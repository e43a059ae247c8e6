"""How rows travel through a stateful Python operator.

The record crosses as one JSON text, written and read natively.  This keeps
nulls and integers intact, which pandas columns would turn into floats.  What
orders the rows crosses in front of it, in the same text: Spark converts the
columns of every key one by one, so that a column costs more than the rows of a
usual key.  Only rows that wait for the watermark cross with their ordering columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from decimal import Decimal
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.operators.names import field, fields, total_order
from brooklet.operators.times import micros
from brooklet.sinks.topics import JSON_OPTIONS
from brooklet.streaming.held import Arrays, Screen, Step, held_state

if TYPE_CHECKING:
    from brooklet.streaming.resume import KeptState


def pack(df: DataFrame, key: str, ts: str, tiebreak: Sequence[str], side: int) -> DataFrame:
    """Columns k, t, side, ties, payload and event_time of a record stream.

    The total order of the batch operators, in columns without nulls: pandas
    would turn whole numbers beside a null into floats.  A tie is two columns, 0
    and a stand-in for null, or 1 and the value.
    """
    ties = []
    for place, column in enumerate(total_order(df, tiebreak)):
        kind = df.schema[tiebreak[place]].dataType if place < len(tiebreak) else T.LongType()
        ties += [column.isNotNull().cast("int").alias(f"has{place}"), F.coalesce(column, _stand_in(kind)).alias(f"tie{place}")]
    return df.select(
        field(key).alias("k"),
        micros(df, ts).alias("t"),
        F.lit(side).alias("side"),
        *ties,
        F.to_json(F.struct(*fields(df)), JSON_OPTIONS).alias("payload"),
    ).withColumn("event_time", F.timestamp_micros("t"))


def _stand_in(kind: T.DataType) -> Column:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return F.lit("").cast(kind)


def unpack(payload: str, schema: T.StructType) -> Column:
    """The record written by ``pack`` as a struct."""
    return F.from_json(F.col(payload), schema, {**JSON_OPTIONS, "mode": "FAILFAST"})


def check_order(df: DataFrame, tiebreak: Sequence[str], lateness: str | None, ordered: bool) -> None:
    """Held rows are stored with their ordering columns, which must be plain."""
    plain = (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType)
    if ordered and lateness is None:
        raise ValueError("rows can only be held back with a lateness bound")
    if ordered and not all(isinstance(df.schema[name].dataType, plain) for name in tiebreak):
        raise ValueError("rows can only be held back when the tiebreak columns are numbers or text")


def keyed_state(
    rows: DataFrame,
    step: Step,
    memory: str,
    output: str,
    expires: Callable[[tuple], int | None],
    lateness: str | None,
    ordered: bool,
    screen: Screen | None = None,
    kept: KeptState | None = None,
) -> DataFrame:
    """Run ``step`` per key over packed ``rows`` in order; it gets and returns what is remembered of the key.

    ``memory`` is the DDL of that memory; ``expires`` (None: never) tells the microsecond up to which it matters.  Without
    ``lateness`` the memory is kept for good.  With it, memory behind the
    watermark is let go, and with ``ordered`` rows are held back until the
    watermark has passed them, so that disorder between micro-batches does no
    harm (``held.HeldRows``).  ``screen`` tells by their times which rows can matter, before they are gathered.
    ``kept`` is the state of a stopped query to go on from (``resume``); records that query would have dropped as late are dropped.
    """
    timed = lateness is not None
    order = [name for name in rows.columns if name not in ("k", "payload", "event_time")]
    if kept is not None:
        if kept.rows.schema["k"].dataType != rows.schema["k"].dataType:
            raise ValueError(f"the state to go on from has keys of type {kept.rows.schema['k'].dataType.simpleString()}")
        due = rows if lateness is None else rows.filter(F.col("t") > kept.watermark)
        return held_state(due, step, order, memory, output, expires, lateness, ordered, screen, kept.rows)
    if ordered:
        return held_state(rows, step, order, memory, output, expires, lateness)
    floats = {name for name in order if isinstance(rows.schema[name].dataType, (T.FloatType, T.DoubleType))}
    ties = F.to_json(F.struct(*[_comparable(rows, name) for name in order if name not in ("t", "side")]))
    row = F.concat(F.col("t").cast("string"), F.lit(" "), F.col("side").cast("string"), ties, F.lit("\n"), "payload").alias("row")
    rows = rows.select("k", row, *(["event_time"] if timed else []))

    def run(_key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        watermark = state.getCurrentWatermarkMs() * 1000 if timed else None
        times, texts = [], []
        for frame in () if state.hasTimedOut else frames:
            split = [row.split(" ", 1) for row in frame["row"].tolist()]
            t = np.array([int(time) for time, _ in split], dtype=np.int64)
            text = np.array([rest for _, rest in split], dtype=object)
            due = None if known is None or screen is None else screen(t, known)
            times.append(t if due is None else t[due])
            texts.append(text if due is None else text[due])
        result = None
        if any(map(len, times)):
            result, known = step(_in_order(np.concatenate(times), np.concatenate(texts), floats), known)
        until = None if known is None or not timed else expires(known)
        if known is None or (until is not None and until < watermark):
            if state.exists:
                state.remove()
        else:
            state.update(known)
            if until is not None:
                state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if result is not None and not result.empty:
            yield result

    if timed:
        rows = rows.withWatermark("event_time", lateness)
    timeout = "EventTimeTimeout" if timed else "NoTimeout"
    return rows.groupBy("k").applyInPandasWithState(run, output, memory, "append", timeout)


def _comparable(rows: DataFrame, name: str) -> Column:
    """A tie as a value that is ordered alike in JSON."""
    kind, column = rows.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        column = F.unix_date(name)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        column = micros(rows, name)
    elif isinstance(kind, T.BinaryType):
        column = F.hex(name)
    return column.alias(name)


def _in_order(times: np.ndarray, texts: np.ndarray, floats: set[str]) -> Arrays:
    """t, side and payload of a key's rows, in their order."""

    def rank(text: str) -> tuple:
        values = json.loads(text[1 : text.index("\n")], parse_float=Decimal)
        return (text[0], *[_number(value) if name in floats else value for name, value in values.items()])

    place = np.argsort(times, kind="stable")
    same = np.diff(times[place]) == 0
    if same.any():
        shared = np.zeros(len(times), dtype=bool)
        shared[place[1:][same]] = shared[place[:-1][same]] = True
        keys = [(t, rank(text) if tied else ()) for t, text, tied in zip(times.tolist(), texts, shared.tolist())]
        place = sorted(range(len(keys)), key=keys.__getitem__)
    texts = texts[place]
    payload = np.empty(len(texts), dtype=object)
    payload[:] = [text[text.index("\n") + 1 :] for text in texts]
    return {"t": times[place], "side": np.array([int(text[0]) for text in texts]), "payload": payload}


def _number(value: Decimal | int | str) -> tuple[bool, float]:
    """JSON has NaN and the infinities as texts; NaN is the largest."""
    number = float(value)
    return (True, 0.0) if number != number else (False, number)
