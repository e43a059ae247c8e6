"""Streams that go on with another number of state partitions give the rows of one run."""

import glob
import os

import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from test_streaming import run, shuffled

from brooklet.operators import dedup, pair_join
from brooklet.session import work_path
from brooklet.sources import file_records, kafka_options
from brooklet.streaming.resume import files_read, finished, kept_state
from workloads import dedup_events_resumed, sides

DAY, SETTING = 86_400, "spark.sql.shuffle.partitions"


def in_turns(spark, feed, build, partitions):
    """Files of ``feed`` arrive in as many turns as there are ``partitions``; each turn is a query of its own that goes on from the last."""
    files = sorted(glob.glob(f"{feed}/part-*.parquet"), key=os.path.getmtime)
    source, parts, state, after, before = work_path(spark, "grown"), [], None, None, spark.conf.get(SETTING)
    schema = spark.read.parquet(feed).schema
    share = -(-len(files) // len(partitions))
    try:
        for turn, number in enumerate(partitions):
            for file in files[turn * share : (turn + 1) * share]:
                spark.read.parquet(file).coalesce(1).write.mode("append").parquet(source)
            spark.conf.set(SETTING, number)
            path = work_path(spark, "turn")
            rows = file_records(spark, source, schema, "parquet", streaming=True, files_per_trigger=2, after=after)
            found, query = run(spark, build(rows, state), path)
            assert max(operator.customMetrics.get("numShufflePartitions", 0) or operator.numShufflePartitions for operator in query.recentProgress[-1].stateOperators) == number
            parts.append(found)
            state = kept_state(spark, f"{path}/progress")
            done = files_read(spark, f"{path}/progress")
            after = done if after is None else after.union(done).distinct()
        assert after.count() >= len(files)
    finally:
        spark.conf.set(SETTING, before)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole, parts


@pytest.fixture(scope="module")
def in_time(spark, events):
    path = work_path(spark, "in-time")
    for part in range(6):
        events.filter(F.floor(F.col("event_id") / 167) == part).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("lateness", [None, "1 hour"])
def test_dedup(spark, events, in_time, lateness):
    def build(rows, state):
        return dedup(rows, "user_id", DAY, "ts", ["event_id"], lateness=lateness, state=state)

    rows, parts = in_turns(spark, in_time, build, [2, 5, 3])
    assert all(part.count() for part in parts)
    assert same_rows(rows, dedup(events, "user_id", DAY, "ts", ["event_id"]))


@pytest.mark.parametrize("lateness", [None, "1 hour"])
def test_pair(spark, events, in_time, lateness):
    def build(rows, state):
        return pair_join(*sides(rows), "user_id", "buyer", DAY, "ts", ["event_id"], lateness=lateness, state=state)

    rows, _ = in_turns(spark, in_time, build, [3, 2])
    assert same_rows(rows, pair_join(*sides(events), "user_id", "buyer", DAY, "ts", ["event_id"]))


def test_rows_that_wait_go_on_waiting(spark, events):
    """Disorder of six days: much is held back when the query stops.  What the last one still holds is not out yet, as in one run."""
    feed, options = shuffled(spark, events, 3), {"lateness": "6 days", "ordered": True}

    def build(rows, state):
        return dedup(rows, "user_id", DAY, "ts", ["event_id"], state=state, **options)

    rows, parts = in_turns(spark, feed, build, [2, 5])
    schema = spark.read.parquet(feed).schema
    once, _ = run(spark, build(file_records(spark, feed, schema, "parquet", streaming=True, files_per_trigger=1), None), work_path(spark, "once"))
    assert same_rows(rows, once) and all(part.count() for part in parts)


def test_sessions_with_the_default_state_store(spark, events):
    """Nothing but Spark's defaults set: the driver's session is not made by ``build_session``."""
    plain = spark.newSession()
    plain.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    assert same_rows(dedup_events_resumed(plain, DATA), dedup(plain.read.parquet(f"{DATA}/events.parquet"), "user_id", DAY, "ts", ["event_id"]))


def test_what_cannot_be_gone_on_from(spark, events, in_time):
    path = work_path(spark, "refused")
    schema = spark.read.parquet(in_time).schema
    rows = file_records(spark, in_time, schema, "parquet", streaming=True)
    run(spark, dedup(rows, "user_id", DAY, "ts", ["event_id"], lateness="1 day"), path)
    state, end = kept_state(spark, f"{path}/progress"), finished(spark, f"{path}/progress")
    assert end.watermark > 0 and len(end.offsets) == 1
    with pytest.raises(ValueError, match="keys of type bigint"):
        dedup(rows, "event_type", DAY, "ts", lateness="1 day", state=state)
    with pytest.raises(ValueError, match="only a stream"):
        dedup(events, "user_id", DAY, "ts", state=state)
    os.remove(f"{path}/progress/commits/{end.batch}")
    crc = f"{path}/progress/commits/.{end.batch}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(ValueError, match="is not finished"):
        finished(spark, f"{path}/progress")


def test_topics_go_on_from_offsets():
    assert kafka_options("host:1", "t", '{"t":{"0":7}}')["startingOffsets"] == '{"t":{"0":7}}'
