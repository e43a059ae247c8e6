"""Record sources: JSON records on a Kafka topic or in files, batch or streaming."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.types import record_schema

# Columns a topic adds to each record; they carry its time and its order.
TOPIC_TIME = "_time"
TOPIC_ORDER = ("_partition", "_offset")


def decode_json(
    df: DataFrame, fields: Mapping[str, str] | T.StructType, text: str = "value", malformed: str = "fail"
) -> DataFrame:
    """Replace JSON column ``text`` by its declared fields.

    Missing fields become null.  A malformed record fails the query, or gives
    nulls with ``malformed="null"``.
    """
    modes = {"fail": "FAILFAST", "null": "PERMISSIVE"}
    if malformed not in modes:
        raise ValueError(f"malformed must be one of {sorted(modes)}")
    schema = fields if isinstance(fields, T.StructType) else record_schema(fields)
    rest = [F.col(name) for name in df.columns if name != text]
    parsed = F.from_json(F.col(text).cast("string"), schema, {"mode": modes[malformed]})
    return df.select(*rest, parsed.alias("__record")).select(*[name for name in df.columns if name != text], "__record.*")


def kafka_options(address: str, topic: str, starting: str = "earliest") -> dict[str, str]:
    """Connection options of a topic that is read from its beginning, or from ``starting`` (offsets as JSON)."""
    return {"kafka.bootstrap.servers": address, "subscribe": topic, "startingOffsets": starting}


def topic_records(raw: DataFrame, fields: Mapping[str, str], malformed: str = "fail") -> DataFrame:
    """Declared fields of raw topic rows, after the record's time and order columns."""
    envelope = raw.select(
        F.col("timestamp").alias(TOPIC_TIME), *[F.col(name[1:]).alias(name) for name in TOPIC_ORDER], "value"
    )
    return decode_json(envelope, fields, "value", malformed)


def kafka_records(
    spark: SparkSession,
    address: str,
    topic: str,
    fields: Mapping[str, str],
    name: str | None = None,
    streaming: bool = True,
    malformed: str = "fail",
    per_trigger: int | None = None,
    starting: str = "earliest",
) -> DataFrame:
    """JSON records of a Kafka topic from the earliest offset (needs the Kafka connector jar).

    ``per_trigger`` bounds the records of one micro-batch, which also bounds
    what a hot key brings to one task of a stateful operator.  ``starting`` are
    the offsets to begin with, as JSON: where another query ended
    (``streaming.resume.finished``).
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**kafka_options(address, topic, starting))
    if streaming:
        if name is not None:
            reader = reader.option("groupIdPrefix", f"source_{name}")
        if per_trigger is not None:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return topic_records(reader.load(), fields, malformed)


def file_records(
    spark: SparkSession,
    path: str,
    schema: Mapping[str, str] | T.StructType,
    file_format: str = "json",
    streaming: bool = False,
    files_per_trigger: int | None = None,
    malformed: str = "fail",
    after: DataFrame | None = None,
) -> DataFrame:
    """Records of a folder of files with a declared schema; no inference pass.

    ``after`` (column ``path``) leaves out files that another query has read
    (``streaming.resume.files_read``); Spark still opens them once.
    """
    declared = schema if isinstance(schema, T.StructType) else record_schema(schema)
    reader = (spark.readStream if streaming else spark.read).schema(declared).format(file_format)
    if file_format == "json":
        reader = reader.option("mode", "FAILFAST" if malformed == "fail" else "PERMISSIVE")
    if streaming and files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(path)
    if after is None:
        return rows
    found = rows.select("*", plain_path(F.col("_metadata.file_path")).alias("__path"))
    done = after.select(F.col("path").alias("__done"))
    return found.join(done, F.col("__path") == F.col("__done"), "left_anti").drop("__path")


def plain_path(path: Column) -> Column:
    """Spark writes local paths with one or three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")
