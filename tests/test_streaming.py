"""The streaming operators give the batch result when rows arrive in time order."""

import os
import random
import time

import pandas as pd
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from brooklet.metrics import LATE, CounterListener, query_totals
from brooklet.operators import dedup, enrich, pair_join
from brooklet.session import work_path
from brooklet.sources import file_records, lookup_table
from brooklet.streaming.held import HeldRows
from workloads import sides

DAY = 86_400


@pytest.fixture(scope="module")
def parts(spark, events):
    """Five files in time order."""
    path = work_path(spark, "parts")
    for part in range(5):
        events.filter(F.col("event_id").between(part * 200, part * 200 + 199)).coalesce(1).write.mode("append").parquet(path)
    return path


def one_by_one(spark, path, events):
    return file_records(spark, path, events.schema, "parquet", streaming=True, files_per_trigger=1)


def run(spark, df, path):
    writer = df.writeStream.format("parquet").option("path", f"{path}/rows")
    query = writer.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows"), query


@pytest.mark.parametrize("lateness", [None, "0 seconds"])
def test_dedup(spark, events, parts, lateness):
    kept = dedup(one_by_one(spark, parts, events), "user_id", DAY, "ts", ["event_id"], lateness=lateness)
    rows, query = run(spark, kept, work_path(spark, "dedup"))
    assert same_rows(rows, dedup(events, "user_id", DAY, "ts", ["event_id"]))
    batches = [progress for progress in query.recentProgress if progress.numInputRows]
    assert len(batches) == 5
    keys = query.recentProgress[-1].stateOperators[0].numRowsTotal
    # the watermark has let the anchors of silent keys go; without it every key is kept
    assert keys == 15 if lateness is None else keys < 15


@pytest.mark.parametrize("ordered", [False, True])
def test_late_rows_are_counted(spark, events, ordered):
    path = work_path(spark, "late")
    for part in (3, 4, 0):
        events.filter(F.col("event_id").between(part * 200, part * 200 + 199)).coalesce(1).write.mode("append").parquet(path)
    seen = []
    listener = CounterListener(lambda name, values: seen.append(values))
    spark.streams.addListener(listener)
    try:
        kept = dedup(one_by_one(spark, path, events), "user_id", DAY, "ts", ["event_id"], lateness="0 seconds", ordered=ordered)
        rows, query = run(spark, kept, work_path(spark, "dedup"))
        assert query_totals(query, late=True) == {LATE: 200} and query_totals(query) == {}
        assert rows.filter("event_id < 200").isEmpty()
        for _ in range(100):
            if sum(values[LATE] for values in seen) == 200:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(values[LATE] for values in seen) == 200


def test_streams_without_state_have_no_late_rows(spark, events, parts):
    _, query = run(spark, one_by_one(spark, parts, events), work_path(spark, "plain"))
    assert query_totals(query, late=True) == {}


@pytest.mark.parametrize("lateness", [None, "0 seconds"])
def test_pair(spark, events, parts, lateness):
    source = one_by_one(spark, parts, events)
    pairs = pair_join(*sides(source), "user_id", "buyer", DAY, "ts", ["event_id"], lateness=lateness)
    rows, _ = run(spark, pairs, work_path(spark, "pair"))
    expected = pair_join(*sides(events), "user_id", "buyer", DAY, "ts", ["event_id"])
    assert same_rows(rows, expected) and rows.count() == 95


def test_state_survives_a_restart(spark, events):
    source, path = work_path(spark, "growing"), work_path(spark, "restart")
    for part in range(5):
        chosen = events.filter(F.col("event_id").between(part * 200, part * 200 + 199))
        chosen.coalesce(1).write.mode("append").parquet(source)
        kept = dedup(one_by_one(spark, source, events), "user_id", DAY, "ts", ["event_id"], lateness="1 hour")
        rows, _ = run(spark, kept, path)
    assert same_rows(rows, dedup(events, "user_id", DAY, "ts", ["event_id"]))


def test_values_survive_the_trip_through_python(spark, events):
    """Nulls, empty texts, large integers, odd floats and both kinds of time."""
    path = work_path(spark, "odd")
    odd = spark.sql("""
        select * from values
          (1, timestamp_ntz '2024-03-10 02:30:00.000001', timestamp '2024-01-01 00:00:00.123456', 9007199254740993L,
           cast(null as int), double('NaN'), '', decimal(1.10), array(1, null), cast(null as string)),
          (2, timestamp_ntz '2024-03-10 02:30:00', timestamp '2024-07-01 00:00:00', -1L,
           7, double('-Infinity'), 'é"\\n', decimal(0), array(), 'x')
        as t(id, ts, at, big, small, number, text, amount, list, note)""")
    odd.coalesce(1).write.parquet(path)
    source = file_records(spark, path, odd.schema, "parquet", streaming=True)
    rows, _ = run(spark, dedup(source, "id", 1, "ts"), work_path(spark, "odd-out"))
    assert same_rows(rows, odd)
    rows, _ = run(spark, dedup(source, "id", 1, "at", lateness="1 day"), work_path(spark, "odd-out"))
    assert same_rows(rows, odd)


def test_enrich_is_stateless(spark, events, parts):
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    names = lookup_table(customers, "c_custkey", "c_name")
    rows, query = run(spark, enrich(one_by_one(spark, parts, events), names, "who", "user_id"), work_path(spark, "enrich"))
    assert same_rows(rows, enrich(events, names, "who", "user_id"))
    assert not query.recentProgress[-1].stateOperators


def test_time_zone_does_not_matter(spark, events, parts):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        kept = dedup(one_by_one(spark, parts, events), "user_id", DAY, "ts", ["event_id"], lateness="0 seconds")
        rows, _ = run(spark, kept, work_path(spark, "zone"))
        assert same_rows(rows, dedup(events, "user_id", DAY, "ts", ["event_id"]))
        assert rows.count() == 313
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shuffled(spark, events, seed):
    """Seven files, each with rows from up to six days around its own: every row is at most six days late."""
    path = work_path(spark, "disorder")
    days = F.datediff("ts", F.lit("2024-01-01")) + F.pmod(F.hash("event_id", F.lit(seed)), F.lit(6))
    for part in range(7):
        rows = events.filter(F.floor(days / 5) == part)
        rows.coalesce(1).write.mode("append").parquet(path)
    # a last row far ahead moves the watermark past all others
    last = events.limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "ts": F.lit("2025-01-01").cast("timestamp_ntz")})
    for kind in ("view", "purchase"):
        last.withColumn("event_type", F.lit(kind)).withColumn("user_id", F.lit(-1).cast("bigint")).coalesce(1).write.mode(
            "append"
        ).parquet(path)
    return path


def test_disorder_is_undone_by_waiting(spark, events):
    source = one_by_one(spark, shuffled(spark, events, 1), events)
    kept = dedup(source, "user_id", DAY, "ts", ["event_id"], lateness="12 days", ordered=True)
    rows, query = run(spark, kept, work_path(spark, "ordered"))
    assert same_rows(rows.filter("user_id >= 0"), dedup(events, "user_id", DAY, "ts", ["event_id"]))
    pairs = pair_join(*sides(source), "user_id", "buyer", DAY, "ts", ["event_id"], lateness="12 days", ordered=True)
    rows, _ = run(spark, pairs, work_path(spark, "ordered"))
    assert same_rows(rows.filter("user_id >= 0"), pair_join(*sides(events), "user_id", "buyer", DAY, "ts", ["event_id"]))


def test_waiting_rows_survive_a_restart(spark, events):
    """Stopped after four of nine files: what waited then comes out later, once."""
    files, path, out = shuffled(spark, events, 2), work_path(spark, "halves"), work_path(spark, "ordered")
    names = sorted(spark.read.parquet(files).select(F.input_file_name().alias("f")).distinct().toPandas()["f"], key=lambda f: os.path.getmtime(f.removeprefix("file://")))
    for part in (names[:4], names[4:]):
        for name in part:
            spark.read.parquet(name).coalesce(1).write.mode("append").parquet(path)
        kept = dedup(one_by_one(spark, path, events), "user_id", DAY, "ts", ["event_id"], lateness="12 days", ordered=True)
        rows, _ = run(spark, kept, out)
    assert same_rows(rows.filter("user_id >= 0"), dedup(events, "user_id", DAY, "ts", ["event_id"]))


class FakeState:
    """State of one key that counts what is written."""

    def __init__(self):
        self.value, self.written = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(())

    def update(self, value):
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.written += len(rows)
        self.value = [*(self.value or []), *rows]

    def put(self, rows):
        self.written += len(rows)
        self.value = list(rows)

    def clear(self):
        self.value = None


class FakeHandle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, FakeState())

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


@pytest.mark.parametrize("width", [1_000, 7_000, 1_000_000])
def test_a_waiting_row_is_written_once(width):
    draw, handle, seen = random.Random(3), FakeHandle(), []

    def step(rows, known):
        seen.extend(rows["payload"].tolist())
        return None, (int(rows["t"].max()),) if len(rows) else known

    held = HeldRows(step, ["t", "side"], "last bigint", "t bigint, side int, payload string", lambda known: known[0], width)
    held.init(handle)
    times = [1_000 * place + draw.randrange(0, 40_000) for place in range(300)]
    for place in range(0, 300, 10):
        chunk = pd.DataFrame({"t": times[place : place + 10], "side": 0, "payload": [str(t) for t in times[place : place + 10]]})
        list(held.handleInputRows(("k",), iter([chunk]), Clock(place)))  # rows come up to 40 ms ahead of the watermark
        for at in [at for at in handle.timers if at <= place]:
            handle.timers.discard(at)
            list(held.handleExpiredTimer(("k",), Clock(place), None))
        assert len(handle.timers) == 1
    while handle.timers:
        at = handle.timers.pop()
        list(held.handleExpiredTimer(("k",), Clock(max(at, 310)), None))
    assert [int(payload) for payload in seen] == sorted(times)
    written = sum(state.written for name, state in handle.states.items() if name.startswith("held"))
    assert written == 300 or width == 1_000  # forty stretches at a time share eight lists
    assert not any(state.exists() for state in handle.states.values())


def test_waiting_needs_a_bound(spark, events, parts):
    with pytest.raises(ValueError, match="lateness"):
        dedup(one_by_one(spark, parts, events), "user_id", DAY, "ts", ["event_id"], ordered=True)
    with pytest.raises(ValueError, match="numbers or text"):
        dedup(one_by_one(spark, parts, events), "user_id", DAY, "ts", ["ts"], lateness="1 day", ordered=True)


def one_file(spark, df, label):
    path = work_path(spark, label)
    df.coalesce(1).write.parquet(path)
    return file_records(spark, path, df.schema, "parquet", streaming=True)


def test_streams_agree_with_batches_on_repeated_times(spark):
    """Large whole numbers and nulls in the tiebreak, copies, and rows that nothing tells apart."""
    df = spark.sql("""
        select id % 3 as k, timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id % 20) as ts,
               if(id % 4 = 0, null, 9007199254740992L + id % 3) as big, if(id % 5 = 0, null, 'n' || id % 2) as note
        from range(240)""")
    for tiebreak in ([], ["big"], ["note", "big"]):
        kept, _ = run(spark, dedup(one_file(spark, df, "ties"), "k", 4, "ts", tiebreak), work_path(spark, "ties-out"))
        assert same_rows(kept, dedup(df, "k", 4, "ts", tiebreak))
        others = df.withColumnsRenamed({"k": "j", "note": "text"}).withColumn("note", F.col("text"))
        sides = one_file(spark, df, "ties"), one_file(spark, others, "ties")
        pairs, _ = run(spark, pair_join(*sides, "k", "j", 3, "ts", tiebreak), work_path(spark, "ties-out"))
        assert same_rows(pairs, pair_join(df, others, "k", "j", 3, "ts", tiebreak)) and pairs.count() > 0


def test_rows_without_time_fail_in_streams(spark):
    df = spark.sql("select 1 as k, timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) as ts from range(3)")
    df = df.unionAll(spark.sql("select 1, cast(null as timestamp_ntz)"))
    with pytest.raises(Exception, match="needs a time"):
        run(spark, dedup(one_file(spark, df, "no-time"), "k", 1), work_path(spark, "no-time-out"))


@pytest.mark.parametrize("kind", ["double", "float", "decimal(20,3)", "string", "date", "timestamp", "timestamp_ntz", "binary", "boolean"])
def test_ties_of_every_kind(spark, kind):
    """Rows of one time: the tie that comes first is kept, as in the batch form."""
    values = {"double": [None, "NaN", "-Infinity", "-2.5", "10.0", "9.0"], "boolean": [None, "true", "false"]}
    values |= {"float": values["double"], "decimal(20,3)": ["9.5", "10.25", "-3", None], "string": ["b", "B", "é\n", "", None]}
    times = ["2024-01-02 10:00:00.5", "2024-01-02 09:00:00", None]
    texts = [(place % 3, text) for place, text in enumerate(3 * values.get(kind, times if kind not in ("date", "binary") else ["2024-01-02", "2023-12-31", None]))]
    rows = spark.createDataFrame(texts, "id int, text string")
    rows = rows.select("id", F.col("text").cast(kind).alias("tie"), F.lit("2024-05-05 12:00:00").cast("timestamp").alias("ts"))
    path = work_path(spark, "ties")
    rows.repartition(3).write.parquet(path)
    fed = file_records(spark, path, rows.schema, "parquet", streaming=True)
    kept, _ = run(spark, dedup(fed, "id", DAY, "ts", ["tie"], lateness="1 day"), work_path(spark, "ties-kept"))
    assert same_rows(kept, dedup(rows, "id", DAY, "ts", ["tie"]))


def test_only_what_is_needed_crosses_to_python(spark, events, parts):
    """Spark converts every column of every key by itself: key, row and the watermark's time, and no others."""
    kept = dedup(one_by_one(spark, parts, events), "user_id", DAY, "ts", ["event_id"], lateness="1 day")
    plan = kept._jdf.queryExecution().analyzed().toString()
    crossing = next(line for line in plan.splitlines() if "FlatMapGroupsInPandasWithState" in line)
    columns = crossing.split("run(", 1)[1].split(")", 1)[0]
    assert [column.split("#")[0] for column in columns.split(", ")] == ["k", "row", "event_time"]
