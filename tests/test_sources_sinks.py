import json
import os

import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from brooklet.session import work_path
from brooklet.sinks import (
    Warehouse,
    append_rows,
    bucket_stream,
    check_title,
    check_warehouse_fields,
    count_rows,
    json_value,
    read_back_topic,
    read_buckets,
    run_init,
    table_columns,
    topic_writer,
    write_buckets,
)
from brooklet.sources import decode_json, file_records, kafka_options, kafka_records, topic_records

FIELDS = {"number": "int", "name": "string", "ok": "bool", "amount": "double"}


def test_json_records(spark):
    good = spark.createDataFrame([('{"number": 1, "ok": true, "extra": 5}',), ('{"amount": 2.5, "name": "é"}',)], "value string")
    assert [tuple(row) for row in decode_json(good, FIELDS).collect()] == [(None, None, 1, True), (2.5, "é", None, None)]
    assert decode_json(good, FIELDS).columns == sorted(FIELDS)


def test_malformed_records_fail_or_become_null(spark):
    bad = spark.createDataFrame([("{broken",)], "value string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        decode_json(bad, FIELDS).collect()
    assert [tuple(row) for row in decode_json(bad, FIELDS, malformed="null").collect()] == [(None,) * 4]
    with pytest.raises(ValueError):
        decode_json(bad, FIELDS, malformed="drop")


def test_topic_rows(spark):
    raw = spark.sql("""select cast(null as binary) as key, cast('{"number": 7}' as binary) as value, 'calls' as topic,
                              3 as partition, 42L as offset, timestamp '2024-01-01' as timestamp, 0 as timestampType""")
    rows = topic_records(raw, FIELDS)
    assert rows.columns == ["_time", "_partition", "_offset", *sorted(FIELDS)]
    assert rows.select("_partition", "_offset", "number").collect() == [(3, 42, 7)]
    assert kafka_options("broker:9092", "calls") == {
        "kafka.bootstrap.servers": "broker:9092", "subscribe": "calls", "startingOffsets": "earliest"
    }


def test_topic_values_keep_nulls_and_field_order(spark):
    df = spark.sql("select 2 as b, cast(null as string) as a, timestamp_ntz '2024-01-01 00:00:00.000001' as t")
    assert json_value(df).collect()[0]["value"] == '{"a":null,"b":2,"t":"2024-01-01T00:00:00.000001"}'


def test_file_source_reads_json_in_both_modes(spark, events):
    path = work_path(spark, "json")
    write_buckets(events, path)
    fields = {"event_id": "int", "event_type": "string", "value": "double"}
    batch = file_records(spark, path, fields)
    assert same_rows(batch, events.select(F.col("event_id").cast("int"), "event_type", "value"))
    assert file_records(spark, path, fields, streaming=True, files_per_trigger=1).isStreaming


def test_bucket_layout(spark, events):
    path = work_path(spark, "buckets")
    write_buckets(events, path, "event_type", rows_per_file=50)
    kinds = {row["event_type"] for row in events.select("event_type").distinct().collect()}
    folders = [name for name in os.listdir(path) if not name.startswith(("_S", "."))]
    assert set(folders) == {f"_bucket={kind}" for kind in kinds}
    for folder in folders:
        for name in os.listdir(f"{path}/{folder}"):
            if name.endswith(".json"):
                records = [json.loads(line) for line in open(f"{path}/{folder}/{name}")]
                assert len(records) <= 50
                assert {record["event_type"] for record in records} == {folder.removeprefix("_bucket=")}
    assert same_rows(read_buckets(spark, path, events.schema), events)


def test_one_record_per_file(spark, events):
    path = work_path(spark, "single")
    few = events.filter("event_type = 'signup' and user_id = 3")
    write_buckets(few, path, "event_type", rows_per_file=1)
    files = [name for name in os.listdir(f"{path}/_bucket=signup") if name.endswith(".json")]
    assert len(files) == few.count() > 1


def test_a_hot_title_of_a_stream_is_written_by_several_tasks(spark, events):
    """Half of the rows have one title; Spark splits it by its bytes, and small titles stay in one file each."""
    path = work_path(spark, "hot-title")
    hot = events.withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("event_id") % 5)))
    hot.repartition(4).write.parquet(f"{path}/in")
    rows = file_records(spark, f"{path}/in", hot.schema, "parquet", streaming=True)
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(setting, "8KB")
    try:
        writer = bucket_stream(rows, f"{path}/rows", "event_type", gather=True).option("checkpointLocation", f"{path}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(setting)
    files = {title: len([name for name in os.listdir(f"{path}/rows/_bucket={title}") if name.endswith(".json")]) for title in ("hot", "t1", "t3")}
    assert files["hot"] > 1 and files["hot"] >= max(files.values())
    assert same_rows(read_buckets(spark, f"{path}/rows", hot.schema), hot)


def test_bucket_stream_continues_without_repeats(spark, events):
    source, path = work_path(spark, "source"), work_path(spark, "stream")
    schema = events.schema

    def run():
        rows = file_records(spark, source, schema, "parquet", streaming=True)
        writer = bucket_stream(rows, f"{path}/rows", "event_type").option("checkpointLocation", f"{path}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()

    events.filter("event_id % 2 = 0").write.mode("append").parquet(source)
    run()
    events.filter("event_id % 2 = 1").write.mode("append").parquet(source)
    run()
    run()
    assert same_rows(read_buckets(spark, f"{path}/rows", schema), events)


def test_warehouse_columns_and_contract(spark):
    df = spark.createDataFrame([("Ann", 1.5)], "person string, time double")
    columns = {"time": "call_time", "person": "who"}
    assert table_columns(df, columns).columns == ["who", "call_time"]
    check_warehouse_fields(df.columns, columns)
    with pytest.raises(ValueError, match="the table takes"):
        check_warehouse_fields(["person"], columns)
    check_title(df.columns, None)
    check_title(df.columns, "person")
    with pytest.raises(ValueError, match="title field"):
        check_title(df.columns, "number")


def test_warehouse_options():
    warehouse = Warehouse("host:5432", "db", "schema.calls", "me", "secret")
    options = warehouse.options()
    assert options["url"] == "jdbc:postgresql://host:5432/db"
    assert (options["dbtable"], options["user"], options["numPartitions"]) == ("schema.calls", "me", "32")
    assert "user" not in Warehouse("h:1", "d", "t").options()


def test_init_is_tried_again_on_connection_errors_only():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("not yet")

    run_init(flaky, pause=0)
    assert len(calls) == 3

    def down():
        calls.append(1)
        raise ConnectionError("down")

    calls.clear()
    with pytest.raises(ConnectionError):
        run_init(down, tries=4, pause=0)
    assert len(calls) == 4

    def wrong():
        calls.append(1)
        raise RuntimeError("syntax error")

    calls.clear()
    with pytest.raises(RuntimeError):
        run_init(wrong, pause=0)
    assert len(calls) == 1


def test_table_folder_and_single_file_as_stream(spark):
    import workloads

    assert workloads.stream(spark, DATA, "events").isStreaming


def test_connectors_are_asked_for_by_name(spark, events):
    """Without the connector jars the failure names what is missing."""
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_records(spark, "broker:9092", "calls", FIELDS)
    with pytest.raises(Exception, match="(?i)kafka"):
        read_back_topic(spark, "broker:9092", "calls", FIELDS)
    with pytest.raises(Exception, match="(?i)kafka"):
        topic_writer(events, "broker:9092", "calls").save()
    warehouse = Warehouse("host:5432", "db", "calls")
    with pytest.raises(Exception, match="postgresql"):
        append_rows(events, warehouse, {"event_id": "number"})
    with pytest.raises(Exception, match="postgresql"):
        count_rows(spark, warehouse)
