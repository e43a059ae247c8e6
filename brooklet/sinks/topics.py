"""Kafka topics as JSON sinks, and reading results back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.operators.names import field
from brooklet.sources.records import decode_json, kafka_options

# Times are written in full; the default text form would cut microseconds.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def json_value(df: DataFrame) -> DataFrame:
    """One JSON object per row in column ``value``: fields in alphabetical order, nulls written, no key."""
    return df.select(F.to_json(F.struct(*map(field, sorted(df.columns))), JSON_OPTIONS).alias("value"))


def topic_writer(df: DataFrame, address: str, topic: str):
    """Writer (batch or streaming) that appends ``df`` to a topic as JSON (needs the Kafka connector jar)."""
    values = json_value(df)
    writer = values.writeStream if df.isStreaming else values.write
    return writer.format("kafka").option("kafka.bootstrap.servers", address).option("topic", topic)


def read_back_topic(spark: SparkSession, address: str, topic: str, fields: Mapping[str, str]) -> DataFrame:
    """All records of a result topic, from its beginning to its present end."""
    raw = spark.read.format("kafka").options(**kafka_options(address, topic)).load()
    return decode_json(raw.select("value"), fields)
