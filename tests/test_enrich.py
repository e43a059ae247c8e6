import pytest
from conftest import DATA, same_rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brooklet.operators import enrich
from brooklet.sources import lookup_table


@pytest.fixture(scope="module")
def people(spark):
    rows = [("1", "Ann"), ("2", ""), ("True", "yes"), ("None", "nobody"), ("1.0", "one")]
    return spark.createDataFrame(rows, "key string, value string")


def test_hits_and_misses(spark, people):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "n int")
    found = {row["n"]: row["who"] for row in enrich(df, people, "who", "n").collect()}
    # a miss is the empty text, never null; the key is the text of the value
    assert found == {1: "Ann", 2: "", 3: "", None: "nobody"}


@pytest.mark.parametrize("value,who", [(True, "yes"), (False, ""), (1.0, "one"), ("1", "Ann")])
def test_keys_are_texts(spark, people, value, who):
    df = spark.createDataFrame([(value,)], ["v"])
    assert enrich(df, people, "who", "v").collect()[0]["who"] == who


def test_key_expressions(spark, people):
    df = spark.createDataFrame([("1:x",), ("9:y",)], "s string")
    assert [row["who"] for row in enrich(df, people, "who", "split_part(s, ':', 1)").orderBy("s").collect()] == ["Ann", ""]


def test_the_field_must_be_new(spark, people):
    with pytest.raises(ValueError, match="already"):
        enrich(spark.createDataFrame([(1,)], "who int"), people, "who", "who")


def test_repeated_keys_fail_or_the_last_one_wins(spark):
    entries = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "only", 1)], "k int, v string, n int")
    df = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(PySparkException, match="more than once"):
        enrich(df, lookup_table(entries, "k", "v"), "who", "k").collect()
    last = enrich(df, lookup_table(entries, "k", "v", version="n"), "who", "k")
    assert [row["who"] for row in last.orderBy("k").collect()] == ["new", "only"]


def test_large_lookup_without_broadcast(spark, events):
    customers = spark.read.parquet(f"{DATA}/customer.parquet")
    names = lookup_table(customers, "c_custkey", "c_name")
    small = enrich(events, names, "customer", "user_id").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        joined = enrich(events, names, "customer", "user_id")
        assert "SortMergeJoin" in joined._jdf.queryExecution().toString()
        assert sorted(joined.collect()) == sorted(small)
        # users with more than 60 events are joined apart, with their own entries broadcast
        split = enrich(events, names, "customer", "user_id", group_rows=60)
        text = split._jdf.queryExecution().toString()
        assert "SortMergeJoin" in text and "BroadcastHashJoin" in text
        assert sorted(split.collect()) == sorted(small)
        # a hot key without an entry stays a miss
        none = enrich(events, names.filter("key = '-1'"), "customer", "user_id", group_rows=60)
        assert none.filter("customer = ''").count() == events.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_demo_counts(spark):
    """2000 calls of 1000 numbers, 900 of them known: 1000 calls after deduplication, 900 hits."""
    from brooklet.operators import dedup, filter_rows

    calls = spark.range(2000).selectExpr(
        "cast(1000000 + id % 1000 as int) as number",
        "cast(pmod(hash(id), 301) as int) as call_time",
        "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, id) as ts",
        "id",
    )
    people = spark.range(100, 1000).selectExpr("1000000 + id as number", "concat('Person №', id) as name")
    once = dedup(calls, "number", 1000, "ts", ["id"])
    assert once.count() == 1000
    assert dedup(calls, "number", 999, "ts", ["id"]).count() == 2000
    known = enrich(once, lookup_table(people, "number", "name"), "person", "number")
    assert filter_rows(known, "person <> ''").count() == 900
    assert same_rows(known.filter("number = 1000100").select("person"), spark.createDataFrame([("Person №100",)], "person string"))
    assert known.filter(F.col("person") == "").count() == 100


def test_repeated_keys_of_any_table_fail(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    table = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", None)], "key string, value string")
    with pytest.raises(Exception, match="more than once"):
        enrich(df, table, "who", "n").collect()
    assert [row["who"] for row in enrich(df, table.filter("key = '2'"), "who", "n").orderBy("n").collect()] == ["", ""]
