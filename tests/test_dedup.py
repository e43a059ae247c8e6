import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from models import dedup_model
from pyspark.sql import functions as F

from brooklet.operators import dedup, pair_join
from brooklet.operators.deduplication import _entered, keep_rows
from brooklet.session import work_path

EPOCH = datetime(2024, 1, 1)
SCHEMA = "k int, ts timestamp_ntz, id int, note string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, EPOCH + timedelta(seconds=t), i, f"n{i}") for k, t, i in rows], schema).repartition(5)


def ids(df):
    return sorted(row["id"] for row in df.collect())


def sample(seed, size, keys, span):
    """Few distinct times, so that ties and gaps of exactly the ttl are common."""
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(span), i) for i in range(size)]


SAMPLES = {
    "many keys": sample(1, 600, [None, *range(20)], 300),
    "one key, dense": sample(2, 600, [7], 400),
    "one key, sparse": sample(3, 200, [7], 20_000),
    "one hot key": sample(4, 400, [1] * 12 + list(range(2, 8)), 500),
    "one instant": [(i % 2, 5, i) for i in range(300)],
    "regular steps": [(1, i, i) for i in range(400)],
}


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("ttl", [1, 10, 120])
def test_scan_equals_model(spark, name, ttl):
    rows = SAMPLES[name]
    assert ids(dedup(frame(spark, rows), "k", ttl, "ts", ["id"], group_rows=None)) == dedup_model(rows, ttl)


@pytest.mark.parametrize("name", SAMPLES)
def test_hot_keys_equal_model(spark, name):
    rows = SAMPLES[name]
    kept = dedup(frame(spark, rows), "k", 10, "ts", ["id"], group_rows=60)
    assert ids(kept) == dedup_model(rows, 10)
    assert kept.columns == ["k", "ts", "id", "note"]


def test_hot_key_whose_blocks_are_shorter_than_the_ttl(spark):
    rows = SAMPLES["one key, dense"]
    assert ids(dedup(frame(spark, rows), "k", 120, "ts", ["id"], group_rows=30)) == dedup_model(rows, 120)


def test_boundaries(spark):
    rows = [(1, 0, 0), (1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 22, 4)]
    # exactly anchor + ttl is suppressed; suppressed rows do not extend the time
    assert ids(dedup(frame(spark, rows), "k", 10, "ts", ["id"])) == [0, 2, 4]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_text_keys_and_both_time_types(spark, kind):
    rows = SAMPLES["many keys"]
    df = frame(spark, rows).withColumn("k", F.concat(F.lit("key-"), "k")).withColumn("ts", F.col("ts").cast(kind))
    for group_rows in (None, 20):
        assert ids(dedup(df, "k", 10, "ts", ["id"], group_rows=group_rows)) == dedup_model(rows, 10)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_a_day_is_86400_seconds_where_clocks_change(spark, kind):
    """Times around the night of 10 March 2024 in New York, one of them in the skipped hour."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        step = 1800
        rows = [(1, i * step, i) for i in range(200)]
        start = "timestamp_ntz '2024-03-08 00:00:00'" if kind == "timestamp_ntz" else "timestamp '2024-03-08 00:00:00Z'"
        df = spark.createDataFrame(rows, "k int, s int, id int").selectExpr("k", f"{start} as start", "s", "id")
        at = F.col("start") + F.make_dt_interval(secs="s") if kind == "timestamp_ntz" else F.timestamp_micros(
            F.unix_micros("start") + F.col("s").cast("bigint") * 1_000_000
        )
        df = df.select("k", at.alias("ts"), "id")
        expected = dedup_model(rows, 86_400)
        for group_rows in (None, 20):
            assert ids(dedup(df, "k", 86_400, "ts", ["id"], group_rows=group_rows)) == expected
        path = work_path(spark, "clocks")
        df.coalesce(1).write.parquet(path)
        stream = dedup(spark.readStream.schema(df.schema).parquet(path), "k", 86_400, "ts", ["id"], lateness="1 day")
        writer = stream.writeStream.option("path", f"{path}-out").option("checkpointLocation", f"{path}-progress")
        writer.trigger(availableNow=True).start().awaitTermination()
        assert ids(spark.read.parquet(f"{path}-out")) == expected
        pair = pair_join(df, df.withColumn("other", F.col("id")), "k", "k", 86_400, "ts", ["id"])
        assert pair.count() == 200
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_crosses_batch_borders():
    rng = random.Random(5)
    rows = sorted((rng.choice("abc"), rng.randrange(2000), i) for i in range(500))
    expected = dedup_model(rows, 9)
    for size in (1, 2, 7, 100, 500):
        state, kept = None, []
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            keys, times = pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.timestamp("us"))
            keep, state = keep_rows(keys, times, 9, state)
            kept += [row[2] for row, wanted in zip(part, keep) if wanted]
        assert sorted(kept) == expected


@given(
    st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60)), min_size=1, max_size=80),
    st.integers(1, 20),
    st.integers(1, 30),
)
@settings(max_examples=300, deadline=None)
def test_any_rows_any_batch_size(rows, ttl, size):
    ordered = sorted(((key, t, i) for i, (key, t) in enumerate(rows)), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    state, kept = None, []
    for at in range(0, len(ordered), size):
        part = ordered[at : at + size]
        keys = pa.array([r[0] for r in part], pa.string())
        keep, state = keep_rows(keys, pa.array([r[1] for r in part], pa.timestamp("us")), ttl, state)
        kept += [row[2] for row, wanted in zip(part, keep) if wanted]
    assert sorted(kept) == dedup_model(ordered, ttl)


def test_rows_without_time_fail(spark):
    df = spark.createDataFrame([(1, None, 1, "x"), (1, EPOCH, 2, "y"), (1, EPOCH, 3, "y")], SCHEMA)
    for group_rows in (None, 1):
        with pytest.raises(Exception, match="needs a time"):
            dedup(df, "k", 10, "ts", ["id"], group_rows=group_rows).collect()


def test_all_ways_agree_without_a_unique_tiebreak(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 2]), EPOCH + timedelta(seconds=rng.randrange(60)), rng.randrange(5), rng.choice("xy")) for _ in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for tiebreak in ([], ["note"]):
        found = [sorted(map(str, dedup(df, "k", 5, "ts", tiebreak, group_rows=n).collect())) for n in (None, 10, 120)]
        assert found[0] and found[1] == found[0] == found[2]


def test_names_with_dots(spark):
    df = frame(spark, SAMPLES["many keys"]).withColumnsRenamed({"k": "a.k", "ts": "a.ts", "id": "a.id"})
    for group_rows in (None, 20):
        kept = dedup(df, "a.k", 10, "a.ts", ["a.id"], group_rows=group_rows)
        assert sorted(row["a.id"] for row in kept.collect()) == dedup_model(SAMPLES["many keys"], 10)


def test_guards(spark, events):
    with pytest.raises(ValueError, match="not in the schema"):
        dedup(events, "nobody", 10)
    with pytest.raises(ValueError, match="greater than 0"):
        dedup(events, "user_id", 0)
    with pytest.raises(ValueError, match="must be a timestamp"):
        dedup(events, "user_id", 10, ts="value")


def test_not_a_session_gap_and_known_count(events):
    assert dedup(events, "user_id", 86400, "ts", ["event_id"]).count() == 313


def test_two_ways_agree_on_real_rows(events):
    plain = dedup(events, "user_id", 3600, "ts", ["event_id"])
    assert same_rows(plain, dedup(events, "user_id", 3600, "ts", ["event_id"], group_rows=50))


@pytest.mark.parametrize("ttl", [1, 50, 3_000])
def test_links_of_a_hot_key_spread_over_the_tasks(spark, ttl):
    """With a ttl over many ranges nearly every time is a border; no task gets more of them than of other rows."""
    n = 4_000
    rows = [(1, 3 * i + i % 2, i) for i in range(n)]
    assert ids(dedup(frame(spark, rows), "k", ttl, "ts", ["id"], group_rows=200)) == dedup_model(rows, ttl)
    edges = spark.createDataFrame([(1, 3 * i, 0, 3 * i, i == 0) for i in range(n)] + [(1, 3 * i, 1, 3 * i + 30, False) for i in range(n - 10)],
                                  "k int, at bigint, kind int, target bigint, known boolean").repartition(4)
    reached = _entered(edges)
    assert sorted(row["at"] for row in reached.collect()) == list(range(30, 3 * n, 30))
    assert all(row["k"] == 1 for row in reached.collect())
    onward = edges.filter("kind = 0").alias("a").join(edges.filter("kind = 1").alias("b"), F.expr("a.k <=> b.k and a.target = b.at"))
    sizes = [row["count"] for row in onward.hint("merge").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 4
