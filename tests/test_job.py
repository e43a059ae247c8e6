import copy
import time

import pytest
from conftest import same_rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import workloads
from brooklet.functions import PythonTextError
from brooklet.metrics import CounterListener, counter_name, query_totals
from brooklet.operators import dedup, enrich, filter_rows, pair_join
from brooklet.plans import Records, build_job
from brooklet.session import work_path
from brooklet.sources import file_records, lookup_table
from brooklet.streaming import Targets, await_job, run_batch, start_job

DAY = 86_400
SCHEMA = {"event_id": "int", "event_type": "string", "user_id": "int", "value": "double"}


def records(df):
    return Records(df, "ts", ["event_id"])


def simple_job(*operators, sinks=None):
    return {
        "sources": {"events": workloads.kafka_source()},
        "sinks": sinks or {"out": workloads.topic_target("out")},
        "operators": {"events": list(operators)},
    }


def final(spark, events, *operators, **options):
    return build_job(spark, simple_job(*operators), {"events": records(events)}, streaming=False, **options).rows("events")


def names(spark):
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    return lookup_table(customers.filter("c_mktsegment = 'BUILDING'"), "c_custkey", "c_name")


@pytest.fixture(scope="module")
def typed(events):
    return events.select("ts", *[F.col(name).cast(kind).alias(name) for name, kind in SCHEMA.items()])


def test_schema_rules(spark, events):
    rows = final(
        spark, events,
        {"operator_type": "field_creator", "field_name": "a", "value": "value", "field_type": "int"},
        {"operator_type": "field_changer", "field_name": "value", "value": "a + 1"},
        {"operator_type": "field_changer", "field_name": "event_id", "value": "event_id", "new_type": "string"},
        {"operator_type": "field_enricher", "field_name": "who", "search_key": "user_id"},
        {"operator_type": "field_deleter", "field_name": "event_type"},
        lookup=names(spark),
    )
    assert {field.name: field.dataType.simpleString() for field in rows.schema} == {
        "a": "int", "event_id": "string", "user_id": "int", "value": "double", "who": "string"
    }
    assert rows.columns == sorted(rows.columns)


@pytest.mark.parametrize("expression", ["item['value'] > 20 and item['event_type'] != 'error'", "value > 20 and event_type <> 'error'"])
def test_record_expressions(spark, events, typed, expression):
    rows = final(spark, events, {"operator_type": "filter", "expression": expression})
    assert same_rows(rows, typed.drop("ts").filter("value > 20 and event_type <> 'error'"))


def test_expressions_are_checked_before_the_job_runs(spark, events):
    for operator, error in [
        ({"operator_type": "filter", "expression": "nobody > 1"}, PySparkException),
        ({"operator_type": "deduplicator", "key": "nobody", "time": 1}, ValueError),
        ({"operator_type": "field_deleter", "field_name": "nobody"}, ValueError),
        ({"operator_type": "field_creator", "field_name": "value", "value": "1", "field_type": "int"}, ValueError),
        ({"operator_type": "field_enricher", "field_name": "x", "search_key": "user_id"}, ValueError),
    ]:
        with pytest.raises(error):
            final(spark, events, operator)


def test_output_contracts(spark, events):
    table = {"sink_type": "greenplum", "address": "h:1", "database": "d", "table": "t", "schema": {"value": "v"}}
    bucket = {"sink_type": "minio", "address": "b", "title_field": "nobody"}
    for sink in (table, bucket):
        job = simple_job({"operator_type": "output", "sink": "s"}, sinks={"s": sink})
        with pytest.raises(ValueError):
            build_job(spark, job, {"events": records(events)}, streaming=False)


def test_clone_sees_the_stream_at_its_point(spark, events):
    built = build_job(spark, workloads.CLONE_JOB, {"events": records(events)}, streaming=False)
    assert built.rows("costly").filter("event_type = 'error'").count() > 0
    assert built.rows("events").filter("event_type = 'error'").count() == 0
    assert [output.sink for output in built.outputs] == ["all", "costly"]


def test_join_order_and_chained_stateful_operators(spark, events, typed):
    job = copy.deepcopy(workloads.JOIN_JOB)
    job["operators"]["events"].insert(3, {"operator_type": "deduplicator", "key": "user_id", "time": 3 * DAY})
    rows = build_job(spark, job, {"events": records(events)}, streaming=False).rows("events")
    views, purchases = typed.filter("event_type = 'view'"), typed.filter("event_type = 'purchase'")
    purchases = purchases.withColumns({"buyer": F.col("user_id"), "paid": F.col("value"), "late": F.col("ts")})
    pairs = pair_join(views, purchases, "user_id", "buyer", DAY, "ts", ["event_id"])
    pairs = pairs.withColumn("at", F.greatest("ts", "late"))
    expected = dedup(pairs, "user_id", 3 * DAY, "at", ["event_id"]).drop("at", "late", "ts")
    assert same_rows(rows, expected) and rows.count() > 10


def test_a_chain_that_needs_its_own_end(spark, events):
    job = copy.deepcopy(workloads.JOIN_JOB)
    job["operators"]["events"].append(job["operators"]["events"].pop(0))
    with pytest.raises(ValueError, match="needs its own end"):
        build_job(spark, job, {"events": records(events)}, streaming=False)


def test_batch_run_writes_every_output_and_counts(spark, events, typed):
    job = copy.deepcopy(workloads.CHAIN_JOB)
    job["sinks"]["early"] = workloads.topic_target("early")
    job["operators"]["events"].insert(2, {"operator_type": "output", "sink": "early"})
    paths = {name: work_path(spark, name) for name in ("out", "early")}
    writers = {name: lambda df, _, path=path: df.write.parquet(path) for name, path in paths.items()}
    built = run_batch(spark, job, {"events": records(events)}, names(spark), Targets(writers))
    kept = dedup(typed.filter("value > 20"), "user_id", DAY, "ts", ["event_id"])
    assert same_rows(spark.read.parquet(paths["early"]), kept.drop("ts"))
    known = filter_rows(enrich(kept, names(spark), "customer", "user_id"), "customer")
    assert spark.read.parquet(paths["out"]).count() == known.count()
    counters = built.counters.batch_values()
    assert counters[counter_name("events", 0, "filter_in")] == events.count()
    assert counters[counter_name("events", 1, "deduplicator_out")] == kept.count()
    assert counters[counter_name("events", 3, "enrichment_count")] == known.count()


def test_counters_with_hot_keys(spark, events, typed):
    path = work_path(spark, "hot")
    writers = {"out": lambda df, _: df.write.parquet(path)}
    job = simple_job({"operator_type": "deduplicator", "key": "user_id", "time": DAY}, {"operator_type": "output", "sink": "out"})
    built = run_batch(spark, job, {"events": records(events)}, targets=Targets(writers), group_rows=40)
    kept = dedup(typed, "user_id", DAY, "ts", ["event_id"]).count()
    assert spark.read.parquet(path).count() == kept
    assert built.counters.batch_values()[counter_name("events", 0, "deduplicator_in")] == 1000


@pytest.fixture
def feed(spark, events):
    """The events as a growing folder: ``feed(n)`` adds the n-th of five parts in time order."""
    path = work_path(spark, "feed")

    def add(part):
        # one file per part, so that the order of arrival is the order of time
        events.filter(F.col("event_id").between(part * 200, part * 200 + 199)).coalesce(1).write.mode("append").parquet(path)

    add(0)
    source = file_records(spark, path, events.schema, "parquet", streaming=True, files_per_trigger=1)
    return add, source


def collector(spark, label):
    """A writer that keeps every micro-batch in its own folder, so that a repeated one replaces itself."""
    path = work_path(spark, label)
    return path, lambda df, batch_id: df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def test_streaming_job_equals_batch_and_continues(spark, events, feed):
    add, source = feed
    path, writer = collector(spark, "chain")
    name = path.rsplit("/", 1)[1]

    def run():
        return start_job(
            spark, workloads.CHAIN_JOB, name, {"events": records(source)}, names(spark), Targets({"out": writer}),
            lateness="1 hour", available_now=True,
        )

    run()
    for part in range(1, 5):
        add(part)
        if part in (2, 4):
            queries = run()
    expected = final(spark, events, *workloads.CHAIN_JOB["operators"]["events"][:-1], lookup=names(spark))
    assert same_rows(spark.read.parquet(path).drop("batch"), expected)
    totals = {name: n for query in queries for name, n in query_totals(query).items()}
    assert totals[counter_name("events", 0, "filter_in")] == 400


def test_streaming_join_of_a_clone(spark, events, feed):
    add, source = feed
    for part in range(1, 5):
        add(part)
    path, writer = collector(spark, "join")
    job = copy.deepcopy(workloads.JOIN_JOB)
    job["operators"]["events"].insert(3, {"operator_type": "deduplicator", "key": "user_id", "time": 3 * DAY})
    start_job(
        spark, job, path.rsplit("/", 1)[1], {"events": records(source)}, targets=Targets({"out": writer}),
        keep_state=True, available_now=True,
    )
    expected = build_job(spark, job, {"events": records(events)}, streaming=False).rows("events")
    assert same_rows(spark.read.parquet(path).drop("batch"), expected)


def test_shared_reads_write_all_outputs(spark, events, feed):
    add, source = feed
    paths, writers = zip(collector(spark, "all"), collector(spark, "costly"))
    queries = start_job(
        spark, workloads.CLONE_JOB, paths[0].rsplit("/", 1)[1], {"events": records(source)},
        targets=Targets(dict(zip(("all", "costly"), writers))), available_now=True,
    )
    assert len(queries) == 1
    built = build_job(spark, workloads.CLONE_JOB, {"events": records(events.filter("event_id < 200"))}, streaming=False)
    for path, output in zip(paths, built.outputs):
        assert same_rows(spark.read.parquet(path).drop("batch"), output.rows)


def test_bucket_output_of_a_streaming_job(spark, events, feed):
    add, source = feed
    path = work_path(spark, "bucket")
    job = simple_job(
        {"operator_type": "output", "sink": "obj"},
        sinks={"obj": {"sink_type": "minio", "address": path.rsplit("/", 1)[1], "title_field": "event_type"}},
    )
    targets = Targets(bucket_path=path.rsplit("/", 1)[0] + "/{address}/")
    start_job(spark, job, path.rsplit("/", 1)[1], {"events": records(source)}, targets=targets, available_now=True)
    assert spark.read.json(path).count() == 200


def test_setup_statement_needs_an_executor(spark, events):
    sink = {"sink_type": "greenplum", "address": "h:1", "database": "d", "table": "t", "schema": {"value": "v"}, "init_sql": "create"}
    job = simple_job(sinks={"wh": sink})
    with pytest.raises(ValueError, match="set-up"):
        run_batch(spark, job, {"events": records(events)})
    seen = []
    run_batch(spark, job, {"events": records(events)}, targets=Targets(execute_sql=lambda sink: seen.append(sink["init_sql"])))
    assert seen == ["create"]


def test_counters_are_published_per_micro_batch(spark, events, feed):
    add, source = feed
    add(1)
    seen = []
    path, writer = collector(spark, "published")
    job = simple_job({"operator_type": "filter", "expression": "value > 20"}, {"operator_type": "output", "sink": "out"})
    start_job(
        spark, job, path.rsplit("/", 1)[1], {"events": records(source)}, targets=Targets({"out": writer}), available_now=True,
        publish=lambda name, values: seen.append((name, values)),
    )
    assert [values[counter_name("events", 0, "filter_in")] for _, values in seen] == [200, 200]
    assert seen[0][0].endswith("events-1-out")


def test_counters_of_pure_streams_reach_the_listener(spark, events, feed):
    seen = []
    path = work_path(spark, "listened")
    listener = CounterListener(lambda name, values: seen.append((name, values)))
    spark.streams.addListener(listener)
    try:
        sinks = {"obj": {"sink_type": "minio", "address": path.rsplit("/", 1)[1]}}
        job = simple_job({"operator_type": "filter", "expression": "value > 20"}, {"operator_type": "output", "sink": "obj"}, sinks=sinks)
        targets = Targets(bucket_path=path.rsplit("/", 1)[0] + "/{address}/")
        start_job(spark, job, path.rsplit("/", 1)[1], {"events": records(feed[1])}, targets=targets, available_now=True)
        for _ in range(100):
            if seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [values[counter_name("events", 0, "filter_in")] for _, values in seen] == [200]


def test_a_writer_that_reads_nothing_does_not_hold_up_its_counters(spark, events, feed, monkeypatch):
    seen, job = [], simple_job({"operator_type": "filter", "expression": "value > 20"}, {"operator_type": "output", "sink": "out"})
    start_job(
        spark, job, work_path(spark, "unread").rsplit("/", 1)[1], {"events": records(feed[1])},
        targets=Targets({"out": lambda df, _: None}), available_now=True, publish=lambda _, values: seen.append(values),
    )
    assert seen == [{}]


def test_a_lookup_is_read_again_for_every_micro_batch(spark, events, feed):
    add, source = feed
    add(1)
    asked = []

    def lookup():
        asked.append(len(asked))
        return spark.createDataFrame([(str(user), f"answer {len(asked)}") for user in range(15)], "key string, value string")

    path, writer = collector(spark, "answers")
    job = simple_job(
        {"operator_type": "field_enricher", "field_name": "who", "search_key": "user_id"}, {"operator_type": "output", "sink": "out"}
    )
    start_job(spark, job, path.rsplit("/", 1)[1], {"events": records(source)}, lookup, Targets({"out": writer}), available_now=True)
    answers = {row["batch"]: row["who"] for row in spark.read.parquet(path).select("batch", "who").distinct().collect()}
    assert len(answers) == 2 and answers[0] != answers[1]


def test_state_needs_a_bound_or_an_explicit_choice(spark, events, feed):
    with pytest.raises(ValueError, match="keep_state"):
        start_job(spark, workloads.CHAIN_JOB, "unbounded", {"events": records(feed[1])}, names(spark))


def test_parallelism_leaves_the_session_alone(spark, events):
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    job = {**simple_job({"operator_type": "output", "sink": "out"}), "settings": {"parallelism": 3}}

    def writer(df, _):
        seen.append((df.sparkSession.conf.get("spark.sql.shuffle.partitions"), df.groupBy("user_id").count().count()))

    run_batch(spark, job, {"events": records(events)}, targets=Targets({"out": writer}))
    assert seen == [("3", 15)] and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_batch_input_is_read_once(spark, events):
    path, total = work_path(spark, "once"), spark.sparkContext.accumulator(0)
    events.write.parquet(path)

    def seen(value):
        total.add(len(value))
        return value

    source = spark.read.parquet(path).withColumn("value", F.pandas_udf(seen, "double")("value"))
    drop = lambda df, _: df.write.format("noop").mode("overwrite").save()
    run_batch(spark, workloads.CLONE_JOB, {"events": records(source)}, targets=Targets({"all": drop, "costly": drop}))
    assert total.value == events.count()


def test_a_failed_query_ends_the_job(spark, events, feed):
    add, source = feed

    def fail(df, _):
        raise RuntimeError("the sink is gone")

    path, writer = collector(spark, "doomed")
    queries = start_job(
        spark, {**workloads.CLONE_JOB, "settings": {"checkpoint_interval": 200}}, path.rsplit("/", 1)[1],
        {"events": records(source)}, targets=Targets({"all": writer, "costly": fail}), shared_reads=False,
    )
    assert len(queries) == 2
    with pytest.raises(Exception, match="the sink is gone"):
        await_job(queries, 60)
    assert not any(query.isActive for query in queries)


def test_fields_that_are_deleted_unread_are_not_shuffled(spark, events):
    job = simple_job(*workloads.CHAIN_JOB["operators"]["events"][:-1])
    df = build_job(spark, job, {"events": records(events)}, names(spark), streaming=False).rows("events")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in text
    read = simple_job(
        {"operator_type": "deduplicator", "key": "user_id", "time": DAY},
        {"operator_type": "filter", "expression": "to_json(item) like '%click%'"},
        {"operator_type": "field_deleter", "field_name": "event_type"},
    )
    rows = build_job(spark, read, {"events": records(events)}, streaming=False).rows("events")
    assert "event_type" not in rows.columns and rows.count() > 0


def test_hidden_names_are_refused(spark, events):
    for operator in (
        {"operator_type": "field_creator", "field_name": "__time", "value": "1", "field_type": "int"},
        {"operator_type": "field_enricher", "field_name": "__x", "search_key": "user_id"},
    ):
        with pytest.raises(ValueError, match="taken"):
            final(spark, events, operator, lookup=names(spark))


@pytest.mark.parametrize("text", ["value % 3", "round(value)", "Float('0.1')", "value%3 > 1"])
def test_what_differs_from_python_is_refused(spark, events, text):
    with pytest.raises(ValueError, match="differ"):
        final(spark, events, {"operator_type": "field_creator", "field_name": "x", "value": text, "field_type": "double"})


def test_texts_and_other_names_are_not_taken_for_operations(spark, events):
    rows = final(spark, events, {"operator_type": "filter", "expression": "event_type <> '50 % round(1)' and py_round(value) >= 0"})
    assert rows.count() == events.count()
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_python_texts_run_unchanged(spark):
    """The texts of the format's examples, and a field whose name is known but for case."""
    rows = spark.createDataFrame([(1, 100, "a:b"), (2, 5, ":c"), (3, 100, None)], "id int, number int, string string")
    job = one_chain_job(
        {"id": "int", "number": "int", "string": "string"},
        {"operator_type": "filter", "expression": "item['number'] == 100"},
        {"operator_type": "field_creator", "field_name": "next", "value": "item['number'] + 1", "field_type": "int"},
        {"operator_type": "field_changer", "field_name": "number", "value": "item['number'] + 1"},
        {"operator_type": "field_enricher", "field_name": "name", "search_key": "item['string'].split(':')[0]"},
    )
    lookup = spark.createDataFrame([("a", "Anna"), ("None", "nobody")], "key string, value string")
    found = build_job(spark, job, {"in": Records(rows, "id", [])}, lookup, streaming=False).rows("in")
    assert sorted(map(tuple, found.select("id", "number", "next", "name", "string").collect())) == [(1, 101, 101, "Anna", "a:b"), (3, 101, 101, "nobody", None)]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for text, message in (("item['Number'] + 1", "no field 'Number'"), ("item['number'].bit_length()", "no method"), ("item['string'] + item['number']", "Add of str and int")):
        bad = one_chain_job({"number": "int", "string": "string"}, {"operator_type": "field_creator", "field_name": "x", "value": text, "field_type": "int"})
        with pytest.raises(PythonTextError, match=message):
            build_job(spark, bad, {"in": Records(rows, "id", [])}, streaming=False)


def one_chain_job(schema, *chain):
    source = {"source_type": "kafka", "address": "a:1", "topic": "t", "schema": schema}
    return {"sources": {"in": source}, "sinks": {}, "operators": {"in": list(chain)}}
