"""Physical plans: what is read, and how often rows are shuffled."""

import workloads
from brooklet.operators import dedup, enrich, filter_rows, pair_join
from brooklet.plans import build_job

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(events):
    text = plan(filter_rows(events, "value > 20").select("event_id"))
    assert "GreaterThan(value,20.0)" in text
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    assert "Exchange" not in text


def test_record_expressions_cost_nothing(spark, events):
    job = {**workloads.CLONE_JOB, "sources": {"events": workloads.kafka_source()}, "operators": {"events": [
        {"operator_type": "filter", "expression": "item['value'] > 20"},
        {"operator_type": "field_deleter", "field_name": "event_type"},
    ]}}
    text = plan(build_job(spark, job, {"events": workloads.event_records(events)}, streaming=False).rows("events"))
    assert "struct(" not in text and "named_struct" not in text
    assert "event_type" not in text


def test_dedup_shuffles_and_sorts_once(events):
    text = plan(dedup(events, "user_id", 60, "ts", ["event_id"]))
    assert text.count("Exchange hashpartitioning(user_id") == 1 == text.count("Exchange")
    assert text.count("Sort [") == 1


def test_pairing_shuffles_and_sorts_once(events):
    text = plan(pair_join(*workloads.sides(events), "user_id", "buyer", 60, "ts", ["event_id"]))
    assert text.count("Exchange hashpartitioning(k") == 1 == text.count("Exchange")
    assert text.count("Sort [") == 1
    # the records are shuffled once, not a second time inside a window argument
    assert "_w0" not in text.split("Exchange")[1]


def test_small_lookup_is_broadcast(spark, events):
    names = workloads.customer_names(spark, DATA)
    joined = enrich(events, names, "who", "user_id")
    joined.collect()
    assert "BroadcastHashJoin" in plan(joined)
