"""Turning a job into DataFrames.

Every chain becomes one lazy DataFrame per output; clones and merged streams are
further references to the same DataFrames.  The records' time and order travel
in hidden columns, which no output shows.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.functions import Expression
from brooklet.functions.python_text import RECORD, is_python_text, python_condition, python_value
from brooklet.functions.sql import register_functions
from brooklet.metrics import Counters
from brooklet.operators.deduplication import dedup
from brooklet.operators.enrichment import hit_column, with_lookup
from brooklet.operators.fields import change_field, create_field, delete_field, filter_rows
from brooklet.operators.hotkeys import GROUP_ROWS
from brooklet.operators.names import HIDDEN, field, fields, present_name
from brooklet.operators.pairing import pair_rows
from brooklet.plans.spec import Job, check_job
from brooklet.sinks.contract import check_title, check_warehouse_fields
from brooklet.sources.records import TOPIC_ORDER, TOPIC_TIME, kafka_records
from brooklet.types import record_schema

# One operator on a DataFrame; with counters it also counts its rows.
Step = Callable[[DataFrame, Counters | None], DataFrame]

TIME = f"{HIDDEN}time"
ORDER = f"{HIDDEN}order"


@dataclass(frozen=True)
class Records:
    """An input of a job: a DataFrame, its time column, and the columns that order equal times."""

    df: DataFrame
    time: str = TOPIC_TIME
    order: Sequence[str] = TOPIC_ORDER


@dataclass(frozen=True)
class Stream:
    """A stream inside a job: the stateless ``steps`` taken on a ``trunk``, and their result ``df``.

    ``orders`` is the number of hidden order columns.  The steps are kept so that
    they can also be taken on one micro-batch of the trunk.
    """

    trunk: DataFrame
    orders: int
    steps: tuple[Step, ...]
    df: DataFrame

    @classmethod
    def start(cls, trunk: DataFrame, orders: int) -> Stream:
        return cls(trunk, orders, (), trunk)

    @property
    def order(self) -> list[str]:
        return [f"{ORDER}{place}" for place in range(self.orders)]

    @property
    def hidden(self) -> list[str]:
        return [TIME, *self.order]

    @property
    def fields(self) -> list[str]:
        return sorted(set(self.df.columns) - set(self.hidden))

    def then(self, step: Step) -> Stream:
        return Stream(self.trunk, self.orders, (*self.steps, step), step(self.df, None))


def take(df: DataFrame, steps: Sequence[Step], counted: Sequence[Step], counters: Counters) -> DataFrame:
    """``steps`` on ``df``; those in ``counted`` count their rows."""
    return reduce(lambda rows, step: step(rows, counters if step in counted else None), steps, df)


@dataclass(frozen=True)
class Output:
    """One output of a job: what is written, and the sink's name and description.

    ``counted`` are the steps whose rows this output counts: every operator is
    counted once, by the first output or stateful operator behind it.
    """

    source: str
    index: int
    sink: str
    target: Mapping
    stream: Stream
    counted: tuple[Step, ...]
    counters: Counters

    @property
    def label(self) -> str:
        return f"{self.source}-{self.index}-{self.sink}"

    @property
    def rows(self) -> DataFrame:
        """Visible fields in alphabetical order."""
        return self.rows_of(self.stream.trunk, self.counters)

    def rows_of(self, trunk: DataFrame, counters: Counters, skip: int = 0) -> DataFrame:
        """The same from one micro-batch of the stream's trunk, or from a result of its first ``skip`` steps."""
        return take(trunk, self.stream.steps[skip:], self.counted, counters).select(*map(field, self.stream.fields))


@dataclass
class BuiltJob:
    """The DataFrames of a job: finished chains, outputs, and their counters."""

    streams: dict[str, Stream] = dataclasses.field(default_factory=dict)
    outputs: list[Output] = dataclasses.field(default_factory=list)
    counters: Counters = dataclasses.field(default_factory=Counters)

    def rows(self, source: str) -> DataFrame:
        """Visible fields of a source at the end of its chain."""
        stream = self.streams[source]
        return stream.df.select(*map(field, stream.fields))


def build_job(
    spark: SparkSession,
    job: Job,
    inputs: Mapping[str, Records] | None = None,
    lookup: Callable[[], DataFrame] | DataFrame | None = None,
    land: Callable[[DataFrame, str], DataFrame] | None = None,
    lateness: str | None = None,
    ordered: bool = False,
    group_rows: int | None = GROUP_ROWS,
    streaming: bool = True,
    rows_per_trigger: int | None = None,
) -> BuiltJob:
    """Build the chains of ``job``; nothing is written yet.

    ``inputs`` replaces the Kafka topics of the named sources.  ``lookup`` is the
    key/value table of the enrichers; a function is called again for every
    micro-batch that is written through ``foreachBatch``, and once for the bucket
    files, which one pure streaming query writes.  ``rows_per_trigger`` bounds
    the records a micro-batch takes from a topic.  ``land`` stores the
    result of a stateful operator and reads it back: always in a streaming job,
    where one query holds one such operator, and in a batch job where the result
    is read more than once.  ``lateness`` and ``ordered`` are the watermark delay
    of such operators and whether they undo disorder.  Expressions that read as
    Python about ``item`` have Python's meaning (``functions.python_text``); all
    others are SQL and may use the functions of ``functions.sql``.
    """
    register_functions(spark)
    check_job(job)
    return _Builder(spark, job, inputs or {}, lookup, land, lateness, ordered, group_rows, streaming, rows_per_trigger).build()


class _Builder:
    def __init__(self, spark, job, inputs, lookup, land, lateness, ordered, group_rows, streaming, rows_per_trigger):
        self.spark, self.job, self.inputs, self.lookup, self.land = spark, job, inputs, lookup, land
        self.lateness, self.ordered, self.group_rows, self.streaming = lateness, ordered, group_rows, streaming
        self.rows_per_trigger = rows_per_trigger
        self.built = BuiltJob()
        self.counted: list[Step] = []
        self.gone: set[tuple[str, str]] = set()
        self.clones: dict[str, Stream] = {}
        self.open: set[str] = set()

    def build(self) -> BuiltJob:
        for name in self.job.get("operators") or {}:
            self.finished(name)
        return self.built

    def finished(self, name: str) -> Stream:
        """The stream at the end of a chain; every chain is built once."""
        if name in self.open:
            raise ValueError(f"the chain of {name!r} needs its own end")
        if name not in self.built.streams:
            self.open.add(name)
            stream = self.opened(name)
            for index, operator in enumerate(self.job["operators"].get(name, [])):
                stream = getattr(self, operator["operator_type"])(name, index, operator, stream)
            self.built.streams[name] = stream
            self.open.remove(name)
        return self.built.streams[name]

    def opened(self, name: str) -> Stream:
        source = self.job["sources"][name]
        if source["source_type"] == "clone":
            if name not in self.clones:
                self.finished(source["source"])
            return self.clones[name]
        records = self.inputs.get(name)
        if records is None:
            topic = kafka_records(self.spark, source["address"], source["topic"], source["schema"], name, self.streaming, per_trigger=self.rows_per_trigger)
            records = Records(topic)
        hidden = [field(records.time).alias(TIME)]
        hidden += [field(column).alias(f"{ORDER}{place}") for place, column in enumerate(records.order)]
        visible = [field(column.name).cast(column.dataType).alias(column.name) for column in record_schema(source["schema"])]
        return Stream.start(records.df.select(*hidden, *visible), len(records.order))

    # --- per-row operators: steps on the present trunk

    def filter(self, name, index, operator, stream):
        def step(df, counters):
            kept = _with_expression(_count(counters, df, name, index, "filter_in"), operator["expression"], filter_rows, python_condition)
            return _count(counters, kept, name, index, "filter_out")

        return stream.then(step)

    def field_creator(self, name, index, operator, stream):
        new, value, kind = operator["field_name"], operator["value"], operator["field_type"]
        return stream.then(lambda df, _: _with_expression(df, value, lambda rows, read: create_field(rows, new, read, kind)))

    def field_changer(self, name, index, operator, stream):
        old, value, kind = operator["field_name"], operator["value"], operator.get("new_type")
        return stream.then(lambda df, _: _with_expression(df, value, lambda rows, read: change_field(rows, old, read, kind)))

    def field_deleter(self, name, index, operator, stream):
        if (name, operator["field_name"]) in self.gone:
            return stream
        return stream.then(lambda df, _: delete_field(df, operator["field_name"]))

    def field_enricher(self, name, index, operator, stream):
        if self.lookup is None:
            raise ValueError(f"operator {name}:{index} needs a lookup table")
        new, key = operator["field_name"], operator["search_key"]

        def step(df, counters):
            table = self.lookup() if callable(self.lookup) else self.lookup
            rows = _count(counters, df, name, index, "enricher_in")
            found = _with_expression(rows, key, lambda rows, read: with_lookup(rows, table, new, read, self.group_rows))
            hit = hit_column(new)
            return _count(counters, found, name, index, "enrichment_count", field(hit)).drop(hit)

        return stream.then(step)

    def unseen(self, stream: Stream) -> tuple[Step, ...]:
        """The steps of ``stream`` that nothing has counted yet; from now on they are counted."""
        new = [step for step in stream.steps if step not in self.counted]
        self.counted += new
        return tuple(new)

    # --- stateful operators: their result is a new trunk

    def reduced(self, name: str, index: int, stream: Stream) -> DataFrame:
        """The rows of ``stream`` for a stateful operator, without the fields that the chain deletes unread."""
        rows = take(stream.trunk, stream.steps, self.unseen(stream), self.built.counters)
        mine = [str(value) for value in self.job["operators"][name][index].values()]
        unused = [column for column in stream.fields if column not in mine and self.deleted_unread(name, index, column)]
        self.gone |= {(name, column) for column in unused}
        return rows.drop(*unused)

    def deleted_unread(self, name: str, index: int, column: str) -> bool:
        for operator in self.job["operators"][name][index + 1 :]:
            if operator["operator_type"] == "field_deleter" and operator["field_name"] == column:
                return True
            texts = [str(value) for value in operator.values()]
            whole_record = any(re.search(rf"\b{RECORD}\b(?!\s*\[)", text) for text in texts)
            read = any(column.lower() in text.lower() for text in texts)
            if whole_record or read or operator["operator_type"] in ("output", "clone", "stream_joiner", "stream_joiner_plug"):
                return False
        return False

    def deduplicator(self, name, index, operator, stream):
        counters = self.built.counters
        rows = counters.count(self.reduced(name, index, stream), name, index, "deduplicator_in")
        kept = dedup(
            rows, operator["key"], operator["time"], TIME, stream.order, self.group_rows, self.lateness, self.ordered
        )
        kept = counters.count(kept, name, index, "deduplicator_out")
        return Stream.start(self.landed(kept, name, index), stream.orders)

    def stream_joiner(self, name, index, operator, stream):
        counters, second = self.built.counters, self.finished(operator["second_source"])
        orders = max(stream.orders, second.orders)
        first_rows = self.reduced(name, index, stream)
        second_rows = take(second.trunk, second.steps, self.unseen(second), counters)
        ours = counters.count(_padded(first_rows, stream, second), name, index, "stream_joiner_first_in")
        theirs = counters.count(_padded(second_rows, second, stream), name, index, "stream_joiner_second_in")
        order = [f"{ORDER}{place}" for place in range(orders)]
        pairs = pair_rows(
            ours, theirs, operator["first_key"], operator["second_key"], operator["time"],
            TIME, order, self.group_rows, self.lateness, self.ordered,
        )
        # A pair happens when its later row arrives; the side completes the order.
        later = F.when(F.col("arrived") == 0, F.struct(*[f"first.{column}" for column in (TIME, *order)])).otherwise(
            F.struct(*[f"second.{column}" for column in (TIME, *order)])
        )
        joined = pairs.select(
            *[later[column].alias(column) for column in (TIME, *order)],
            F.col("arrived").alias(f"{ORDER}{orders}"),
            *[F.col("first").getField(column).alias(column) for column in first_rows.columns if column in stream.fields],
            *[F.col("second").getField(column).alias(column) for column in second.fields if present_name(stream.df, column) is None],
        )
        joined = counters.count(joined, name, index, "stream_joiner_out")
        return Stream.start(self.landed(joined, name, index), orders + 1)

    def landed(self, df: DataFrame, name: str, index: int) -> DataFrame:
        if self.land is None:
            if df.isStreaming:
                raise ValueError("a streaming job with a stateful operator needs a place to land its result")
            return df
        return self.land(df, f"{name}-{index}") if df.isStreaming or self.reused(name, index) else df

    def reused(self, name: str, index: int) -> bool:
        """Is the result of this operator read more than once?  A stateful operator looks for hot keys first."""
        later = [operator["operator_type"] for operator in self.job["operators"][name][index + 1 :]]
        stateful = {"deduplicator", "stream_joiner", "stream_joiner_plug", "clone"} & set(later)
        return bool(stateful) or later.count("output") > 1

    # --- routing

    def clone(self, name, index, operator, stream):
        self.clones[operator["clone_name"]] = stream
        return stream

    def stream_joiner_plug(self, name, index, operator, stream):
        return stream

    def output(self, name, index, operator, stream):
        target = self.job["sinks"][operator["sink"]]
        if target["sink_type"] == "greenplum":
            check_warehouse_fields(stream.fields, target["schema"])
        elif target["sink_type"] == "minio":
            check_title(stream.fields, target.get("title_field"))
        self.built.outputs.append(Output(name, index, operator["sink"], target, stream, self.unseen(stream), self.built.counters))
        return stream


def _with_expression(
    df: DataFrame, text: Expression, apply: Callable[[DataFrame, Expression], DataFrame], python: Callable[..., Column] = python_value
) -> DataFrame:
    """``apply`` with a job's expression: Python about ``item`` becomes columns, everything else is SQL."""
    if isinstance(text, str) and is_python_text(text):
        return apply(df, python(text, T.StructType([column for column in df.schema if not column.name.startswith(HIDDEN)])))
    return _with_record(df, lambda rows: apply(rows, text))


def _with_record(df: DataFrame, apply: Step) -> DataFrame:
    """Let SQL expressions also name the whole record: ``upper(item['name'])``.

    The struct exists in the logical plan only; the optimizer takes it away.
    """
    if RECORD in df.columns:
        return apply(df)
    return apply(df.withColumn(RECORD, F.struct(*fields(df)))).drop(RECORD)


def _count(counters: Counters | None, df: DataFrame, name: str, index: int, counter: str, where: Column | None = None) -> DataFrame:
    return df if counters is None else counters.count(df, name, index, counter, where)


def _padded(rows: DataFrame, stream: Stream, other: Stream) -> DataFrame:
    """``rows`` of ``stream`` with the order columns it lacks against ``other``, all zero."""
    missing = other.df.select(other.order[stream.orders:]).schema
    return rows.withColumns({column.name: F.lit(0).cast(column.dataType) for column in missing})
