"""Row counters of the operators, read from Spark's observed metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# The counter names.
COUNTERS = (
    "filter_in",
    "filter_out",
    "deduplicator_in",
    "deduplicator_out",
    "enricher_in",
    "enrichment_count",
    "stream_joiner_first_in",
    "stream_joiner_second_in",
    "stream_joiner_out",
)

# Rows that came behind the watermark, which Spark drops before a stateful operator sees them; one value per query.
LATE = "late_rows"


def counter_name(source: str, index: int, counter: str) -> str:
    """Full name of a counter: the operator's chain, its place in the chain, and what is counted."""
    if counter not in COUNTERS:
        raise ValueError(f"unknown counter {counter!r}")
    return f"[{source}:{index}] {counter}"


class Counters:
    """Attaches counters to DataFrames and collects their values afterwards.

    Counting happens inside the job that reads the data; it adds no pass and no shuffle.
    """

    def __init__(self) -> None:
        self._batch: dict[str, Observation] = {}

    def count(self, df: DataFrame, source: str, index: int, counter: str, where: Column | None = None) -> DataFrame:
        """``df`` with its rows (or those that satisfy ``where``) counted."""
        name = counter_name(source, index, counter)
        value = (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("n")
        if df.isStreaming:
            return df.observe(name, value)
        self._batch[name] = Observation(name)
        return df.observe(self._batch[name], value)

    def batch_values(self, wait: float | None = None) -> dict[str, int]:
        """Values after the batch results have been computed.

        ``wait`` bounds the seconds spent on results that nobody computed; their counters are left out.
        """
        until = None if wait is None else time.monotonic() + wait
        done = {}
        for name, seen in self._batch.items():
            while until is not None and not seen._jo.future().isCompleted() and time.monotonic() < until:
                time.sleep(0.02)
            if until is None or seen._jo.future().isCompleted():
                done[name] = seen.get["n"]
        return done


def progress_values(progress) -> dict[str, int]:
    """Counter values of one micro-batch, from a StreamingQueryProgress or its dict form."""
    observed = progress["observedMetrics"] if isinstance(progress, Mapping) else progress.observedMetrics
    return {name: row["n"] for name, row in (observed or {}).items()}


def late_rows(progress) -> dict[str, int]:
    """Rows of one micro-batch that its stateful operators did not see because they were late; nothing for a query without state."""
    plain = isinstance(progress, Mapping)
    operators = progress["stateOperators"] if plain else progress.stateOperators
    if not operators:
        return {}
    return {LATE: sum(one["numRowsDroppedByWatermark"] if plain else one.numRowsDroppedByWatermark for one in operators)}


def query_totals(query, late: bool = False) -> dict[str, int]:
    """Counter values summed over the recent micro-batches of a streaming query; with ``late`` also its late rows."""
    totals: dict[str, int] = {}
    for progress in query.recentProgress:
        for name, value in {**progress_values(progress), **(late_rows(progress) if late else {})}.items():
            totals[name] = totals.get(name, 0) + value
    return totals


class CounterListener(StreamingQueryListener):
    """Hands the counters of every micro-batch, and its late rows, to ``publish(query name, values)``.

    Register it with ``spark.streams.addListener``; ``publish`` forwards the
    values to whatever collects metrics.
    """

    def __init__(self, publish: Callable[[str, dict[str, int]], None]) -> None:
        self._publish = publish

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        values = {**progress_values(event.progress), **late_rows(event.progress)}
        if values:
            self._publish(event.progress.name, values)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
