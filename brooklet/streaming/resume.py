"""Going on from a stopped streaming query with another number of state partitions.

Spark fixes the partitions of keyed state for the life of a checkpoint.  To
change them, a new query with a checkpoint of its own takes over: it begins with
the state of the stopped one, dealt out anew by key, and reads its source from
where the stopped one ended.

    old = finished(spark, checkpoint)
    rows = file_records(spark, path, schema, streaming=True, after=files_read(spark, checkpoint))
    kept = dedup(rows, key, ttl, lateness=..., state=kept_state(spark, checkpoint))

Topics: ``kafka_records(..., starting=old.offsets[0])``.  The new query writes to
a place of its own, or to a sink that takes rows from anywhere.  As long as it
runs it is started with the same ``state`` and ``after``, and the old checkpoint
stays where it is; a later change of the partitions begins from its checkpoint.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.sinks.topics import JSON_OPTIONS
from brooklet.sources.records import plain_path
from brooklet.streaming.held import HELD, LISTS, MEMORY


@dataclass(frozen=True)
class Finished:
    """Where a stopped query ended: its last micro-batch, the watermark of that (microseconds), and every source's offsets."""

    batch: int
    watermark: int
    offsets: tuple[str, ...]


@dataclass(frozen=True)
class KeptState:
    """State of a stopped query as rows (k, kind, content), and the watermark behind which it dropped records."""

    rows: DataFrame
    watermark: int


def finished(spark: SparkSession, checkpoint: str) -> Finished:
    """Read from the checkpoint of a query that has stopped.

    A query that was stopped within a micro-batch is refused, because its sink
    may have that batch or parts of it: start it once more and let it end.
    """

    def last(log: str) -> tuple[int, str]:
        files = spark.read.text(f"{checkpoint}/{log}", wholetext=True)
        number = F.expr("try_cast(_metadata.file_name AS int)").alias("number")
        found = files.select(number, "value").filter("number IS NOT NULL").orderBy(F.desc("number")).first()
        if found is None:
            raise ValueError(f"{checkpoint} has no finished micro-batch")
        return found["number"], found["value"]

    (batch, planned), (done, _) = last("offsets"), last("commits")
    if batch != done:
        raise ValueError(f"micro-batch {batch} of {checkpoint} is not finished: start the query once more and let it end")
    version, facts, *offsets = planned.strip().split("\n")
    if version != "v1":
        raise ValueError(f"{checkpoint} has offsets of version {version!r}, not 'v1'")
    return Finished(batch, json.loads(facts)["batchWatermarkMs"] * 1000, tuple(offsets))


def files_read(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """Files (column ``path``) that the query's file source has read; sources count in the order of the query."""
    finished(spark, checkpoint)
    entries = spark.read.text(f"{checkpoint}/sources/{source}").filter(F.col("value").startswith("{"))
    return entries.select(plain_path(F.get_json_object("value", "$.path")).alias("path")).distinct()


def kept_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> KeptState:
    """State of the keyed operator of a stopped query: what is remembered per key, and rows that wait for the watermark."""
    end = finished(spark, checkpoint)
    known = spark.read.format("state-metadata").load(checkpoint).filter(F.col("operatorId") == operator)
    name = known.select("operatorName").first()["operatorName"]
    reader = spark.read.format("statestore").option("operatorId", operator)
    if name == "applyInPandasWithState":
        memory = reader.load(checkpoint).select("key.k", F.col("value.groupState").alias("memory"))
        return KeptState(_content(memory, MEMORY), end.watermark)
    if not name.startswith("transformWithState"):
        raise ValueError(f"operator {operator} of {checkpoint} is a {name}, which keeps no state of this library")

    def variable(wanted: str) -> DataFrame:
        return reader.option("stateVarName", wanted).load(checkpoint)

    memory = variable("known").select("key.k", F.col("value").alias("memory"))
    lists = [variable(f"held{place}").select("key.k", F.col("list_element").alias("memory")) for place in range(LISTS)]
    # What lies before ``upto`` has been given out, though its list is still there.
    plans = variable("plan").select(F.col("key.k").alias("plan_k"), F.coalesce("value.upto", F.lit(0)).alias("upto"))
    held = reduce(DataFrame.unionAll, lists).join(plans, F.col("k").eqNullSafe(F.col("plan_k")))
    held = held.filter(F.col("memory.t") >= F.col("upto")).select("k", "memory")
    return KeptState(_content(memory, MEMORY).unionAll(_content(held, HELD)), end.watermark)


def _content(states: DataFrame, kind: int) -> DataFrame:
    return states.select("k", F.lit(kind).alias("kind"), F.to_json("memory", JSON_OPTIONS).alias("content"))
