import random
from datetime import datetime, timedelta

import pytest
from models import pair_model
from pyspark.sql import functions as F

from brooklet.operators import pair_join

EPOCH = datetime(2024, 1, 1)


def frame(spark, rows, name):
    data = [(k, EPOCH + timedelta(seconds=t), i, f"{name}{i}") for k, t, i in rows]
    return spark.createDataFrame(data, f"{name}_key int, ts timestamp_ntz, id int, {name}_note string").repartition(3)


def pairs(spark, first, second, ttl, **options):
    ours, theirs = frame(spark, first, "a"), frame(spark, second, "b").withColumn("b_id", F.col("id"))
    joined = pair_join(ours, theirs, "a_key", "b_key", ttl, "ts", ["id"], **options)
    assert joined.columns == ["a_key", "ts", "id", "a_note", "b_key", "b_note", "b_id"]
    rows = joined.collect()
    assert all(row["a_note"] == f"a{row['id']}" and row["b_note"] == f"b{row['b_id']}" for row in rows)
    assert all(row["a_key"] == row["b_key"] for row in rows)
    return sorted((row["id"], row["b_id"]) for row in rows)


def sample(seed, size, keys, span):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(span), i) for i in range(size)]


SAMPLES = {
    "many keys": (sample(1, 300, [None, *range(15)], 200), sample(2, 300, [None, *range(15)], 200)),
    "one key, dense": (sample(3, 300, [7], 300), sample(4, 300, [7], 300)),
    "one key, sparse": (sample(5, 200, [7], 9000), sample(6, 200, [7], 9000)),
    "uneven sides": (sample(7, 500, [1], 900), sample(8, 40, [1], 900)),
    "one instant": ([(1, 5, i) for i in range(150)], [(1, 5, i) for i in range(100)]),
    "alternating": ([(1, 2 * i, i) for i in range(200)], [(1, 2 * i + 1, i) for i in range(200)]),
}


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("ttl", [1, 5, 60])
def test_equals_two_slot_model(spark, name, ttl):
    first, second = SAMPLES[name]
    assert pairs(spark, first, second, ttl, group_rows=None) == pair_model(first, second, ttl)


@pytest.mark.parametrize("name", SAMPLES)
def test_hot_keys_equal_model(spark, name):
    first, second = SAMPLES[name]
    assert pairs(spark, first, second, 5, group_rows=35) == pair_model(first, second, 5)


def test_a_run_of_links_over_many_blocks(spark):
    first, second = SAMPLES["alternating"]
    assert pairs(spark, first, second, 60, group_rows=10) == pair_model(first, second, 60)


def test_boundary_replacement_and_single_use(spark):
    first = [(1, 0, 0), (1, 1, 1), (2, 0, 2), (3, 0, 3)]
    second = [(1, 11, 0), (1, 12, 1), (2, 11, 2)]
    # the newer row waits; exactly ttl later still pairs; a used row pairs no more; 1 s beyond does not
    assert pairs(spark, first, second, 10) == [(1, 0)]


def test_main_side_wins(spark):
    ours = frame(spark, [(1, 0, 5)], "a").withColumn("who", F.lit("main"))
    theirs = frame(spark, [(1, 1, 6)], "b").withColumn("who", F.lit("second"))
    for left, right, who in ((ours, theirs, "main"), (theirs, ours, "second")):
        keys = (left.columns[0], right.columns[0])
        row = pair_join(left, right, *keys, 10, "ts", ["id"]).collect()[0]
        assert row["who"] == who


def test_guards(spark, events):
    with pytest.raises(ValueError, match="not in the schema"):
        pair_join(events, events, "user_id", "nobody", 10)
    with pytest.raises(ValueError, match="greater than 0"):
        pair_join(events, events, "user_id", "user_id", -1)
    with pytest.raises(ValueError, match="differ in type"):
        pair_join(events, events, "user_id", "event_type", 10)


def repeated(spark, seed, size, name):
    """Rows with few times, few notes and many copies, and nothing that tells them apart."""
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 2]), EPOCH + timedelta(seconds=rng.randrange(40)), rng.choice("xyz")) for _ in range(size)]
    return spark.createDataFrame(data, f"{name}_key int, ts timestamp_ntz, {name}_note string").repartition(3)


@pytest.mark.parametrize("tiebreak", [[], ["note"]])
def test_all_ways_agree_without_a_unique_tiebreak(spark, tiebreak):
    first, second = (repeated(spark, seed, size, "a").withColumnRenamed("a_note", "note") for seed, size in ((8, 200), (9, 160)))
    second = second.withColumnsRenamed({"a_key": "b_key"}).withColumn("b_note", F.col("note"))
    found = [
        sorted(map(str, pair_join(first, second, "a_key", "b_key", 3, "ts", tiebreak, group_rows=rows).collect()))
        for rows in (None, 5, 30, 100)
    ]
    assert found[0] and all(other == found[0] for other in found)


def test_rows_without_time_fail(spark):
    first = spark.createDataFrame([(1, None, 1)], "k int, ts timestamp_ntz, id int")
    for rows in (None, 1):
        for sides in ((first, first.withColumn("ts", F.lit(EPOCH).cast("timestamp_ntz"))), (first.withColumn("ts", F.lit(EPOCH).cast("timestamp_ntz")), first)):
            with pytest.raises(Exception, match="needs a time"):
                pair_join(*sides, "k", "k", 10, group_rows=rows).collect()


def test_names_that_differ_in_case_or_hold_dots(spark):
    ours = spark.createDataFrame([(1, EPOCH, "main")], "`a.b` int, ts timestamp_ntz, who string")
    theirs = spark.createDataFrame([(1, EPOCH, "second", 5)], "`a.b` int, ts timestamp_ntz, Who string, `c.d` int")
    for rows in (None, 1):
        found = pair_join(ours, theirs, "a.b", "a.b", 10, group_rows=rows)
        assert found.columns == ["a.b", "ts", "who", "c.d"]
        assert [tuple(row) for row in found.collect()] == [(1, EPOCH, "main", 5)]
