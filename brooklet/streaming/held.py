"""Rows of a stream that wait for the watermark, as list state with timers.

What waits is cut into stretches of time, and each stretch is a list that rows
are appended to: a row is written once, when it comes, and read when the
watermark reaches its stretch.  A list goes when the watermark has passed it.
One timer per key stands for the next moment at which something is due.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brooklet.session import use_rocksdb

# Columns t, side and payload of one key's rows, in order.
Arrays = dict[str, np.ndarray]

Step = Callable[[Arrays, "tuple | None"], "tuple[pd.DataFrame | None, tuple | None]"]

# Of rows with these times, those that can matter.
Screen = Callable[[np.ndarray, tuple], np.ndarray]

# Kinds of state a query begins with, when it goes on from another one (``resume``).
MEMORY, HELD = 0, 1

# Lists per key; more stretches than these at a time share lists, which costs time but changes nothing.
LISTS = 8


class HeldRows(StatefulProcessor):
    """Gives each key's rows to ``step`` in order, once the watermark has passed them.

    With ``hold=False`` rows do not wait, and ``screen`` may drop those that cannot matter; with ``timed=False`` there is no watermark.
    """

    def __init__(
        self, step: Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame | None, tuple | None]], order: list[str], memory: str, held: str, expires: Callable[[tuple], int | None], width: int,
        hold: bool = True, timed: bool = True, screen: Screen | None = None,
    ) -> None:
        self.step, self.order, self.columns = step, order, [*order, "payload"]
        self.memory, self.held, self.expires, self.width = memory, held, expires, width
        self.hold, self.timed, self.screen = hold, timed, screen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.memory)
        # Up to where held rows have been given out; the timer; the first row that waits in each stretch (JSON).
        self.plan = handle.getValueState("plan", "upto bigint, timer bigint, stretches string")
        self.lists = [handle.getListState(f"held{place}", self.held) for place in range(LISTS)]

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = tuple(self.known.get()) if self.screen is not None and self.known.exists() else None
        frames = (frame if known is None else frame[self.screen(frame["t"].to_numpy(), known)] for frame in rows)
        found = pd.concat([frame[self.columns] for frame in frames])
        yield from self._advance(found, self._watermark(timerValues))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """Takes over what another query remembered of the key, and the rows that waited there; may come in several frames."""
        held = []
        for kind, content in zip(initialState["kind"], initialState["content"]):
            values = json.loads(content)
            if kind == MEMORY:
                self.known.update(tuple(values[name] for name in _names(self.memory)))
            elif self.hold:
                held.append(tuple(float(values[name]) if name in _floats(self.held) else values[name] for name in self.columns))
            else:
                raise ValueError("rows wait for the watermark in the state to go on from: go on with ordered=True")
        watermark = self._watermark(timerValues)
        _, timer, waiting = self._planned()
        if held:
            self._hold(pd.DataFrame(held, columns=self.columns), waiting)
        known = tuple(self.known.get()) if self.known.exists() else None
        self._plan(waiting, None if known is None else self.expires(known), timer, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(pd.DataFrame(columns=self.columns), self._watermark(timerValues))

    def close(self) -> None:
        pass

    def _advance(self, found: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        upto, timer, waiting = self._planned()
        known = tuple(self.known.get()) if self.known.exists() else None
        if self.hold:
            due = [found[found["t"] < watermark], *self._given_out(waiting, upto, watermark)]
            self._hold(found[found["t"] >= watermark], waiting)
        else:
            due = [found]
        rows = pd.concat([part for part in due if len(part)] or due[:1])
        result, now = self.step(self._in_order(rows), known)
        until = None if now is None else self.expires(now)
        if until is not None and until < watermark and not waiting:
            now = until = None
        if now is None and known is not None:
            self.known.clear()
        elif now is not None and now != known:
            self.known.update(now)
        self._plan(waiting, until, timer, watermark)
        if result is not None and not result.empty:
            yield result

    def _in_order(self, rows: pd.DataFrame) -> pd.DataFrame:
        """By time alone where that tells all rows apart: every further column takes longer than the rows of a usual key."""
        first = self.order[0]
        return rows.sort_values(first if rows[first].is_unique else self.order, kind="stable")

    def _watermark(self, timer_values) -> int:
        return timer_values.getCurrentWatermarkInMs() * 1000 if self.timed else 0

    def _planned(self) -> tuple[int | None, int | None, dict[int, int]]:
        upto, timer, stretches = self.plan.get() if self.plan.exists() else (None, None, "{}")
        return upto, timer, {int(stretch): first for stretch, first in json.loads(stretches).items()}

    def _plan(self, waiting: dict[int, int], until: int | None, timer: int | None, watermark: int) -> None:
        """Note what waits, and set the timer to the next moment at which something is due."""
        moments = [*waiting.values(), *([] if until is None else [max(until, watermark)])]
        following = min(moments) // 1000 + 1 if moments else None
        if timer != following:
            if timer is not None and timer * 1000 > watermark:
                self.handle.deleteTimer(timer)
            if following is not None:
                self.handle.registerTimer(following)
        if following is None:
            self.plan.clear()
        else:
            self.plan.update((watermark, following, json.dumps(waiting)))

    def _hold(self, rows: pd.DataFrame, waiting: dict[int, int]) -> None:
        stretch = rows["t"] // self.width
        for number, part in rows.groupby(stretch.astype("int64")):
            number, first = int(number), int(part["t"].min())
            self.lists[number % LISTS].appendList([tuple(row) for row in part.astype(object).to_numpy().tolist()])
            waiting[number] = min(first, waiting.get(number, first))

    def _given_out(self, waiting: dict[int, int], upto: int | None, watermark: int) -> Iterator[pd.DataFrame]:
        """Held rows that the watermark has passed since the last time."""
        for number in sorted(waiting):
            if waiting[number] >= watermark:
                continue
            stored = self.lists[number % LISTS]
            rows = pd.DataFrame([tuple(row) for row in stored.get()], columns=self.columns)
            own = rows["t"] // self.width == number
            open_rows = rows[own & (rows["t"] >= (upto or 0))]
            later = open_rows[open_rows["t"] >= watermark]
            if len(later):
                waiting[number] = int(later["t"].min())
            else:
                del waiting[number]
                others = rows[~own]
                if len(others):
                    stored.put([tuple(row) for row in others.astype(object).to_numpy().tolist()])
                else:
                    stored.clear()
            yield open_rows[open_rows["t"] < watermark]


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _floats(ddl: str) -> set[str]:
    return {part.split()[0] for part in ddl.split(", ") if part.split()[1] in ("double", "float")}


def held_state(
    rows: DataFrame, step: Step, order: list[str], memory: str, output: str, expires: Callable[[tuple], int | None], lateness: str | None,
    ordered: bool = True, screen: Screen | None = None, start: DataFrame | None = None,
) -> DataFrame:
    """``step`` per key over packed ``rows``, with ``ordered`` behind the watermark; see ``rows.keyed_state``.

    ``start`` is the state (k, kind, content) to begin with.
    """
    def by_arrays(found: pd.DataFrame, known: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
        return step({name: found[name].to_numpy() for name in ("t", "side", "payload")}, known)

    use_rocksdb(rows.sparkSession)
    held = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in (*order, "payload"))
    initial = None if start is None else start.groupBy("k")
    if lateness is None:
        processor = HeldRows(by_arrays, order, memory, held, lambda known: None, 1000, False, False, screen)
        return rows.groupBy("k").transformWithStateInPandas(processor, output, "Append", "None", initial)
    micros = rows.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{lateness}')").first()[0]
    processor = HeldRows(by_arrays, order, memory, held, expires, max(1000, micros // 2), ordered, True, None if ordered else screen)
    timed = rows.withWatermark("event_time", lateness)
    return timed.groupBy("k").transformWithStateInPandas(processor, output, "Append", "EventTime", initial)
