import copy

import pytest

from brooklet.plans import check_job, dump_json, dump_yaml, load_json, load_yaml

JOB = {
    "settings": {"parallelism": 2, "min_pause_between_checkpoints": 60000, "checkpoint_interval": 30000},
    "sources": {
        "calls": {"source_type": "kafka", "address": "kafka:9092", "topic": "calls", "schema": {"number": "int", "call_time": "int"}},
        "copy": {"source_type": "clone", "source": "calls"},
    },
    "sinks": {
        "out": {"sink_type": "kafka", "address": "kafka:9092", "topic": "person_calls"},
        "obj": {"sink_type": "minio", "address": "results", "title_field": "number"},
        "wh": {"sink_type": "greenplum", "address": "db:5432", "database": "d", "table": "t", "schema": {"person": "who"}},
    },
    "operators": {
        "calls": [
            {"operator_type": "deduplicator", "key": "number", "time": 60},
            {"operator_type": "clone", "clone_name": "copy"},
            {"operator_type": "field_enricher", "field_name": "person", "search_key": "string(number)"},
            {"operator_type": "filter", "expression": "person <> ''"},
            {"operator_type": "output", "sink": "out"},
        ],
        "copy": [{"operator_type": "output", "sink": "obj"}],
    },
}


def test_round_trips():
    assert load_json(dump_json(JOB)) == JOB
    assert load_yaml(dump_yaml(JOB)) == JOB


def joiner(**changes):
    return {"operator_type": "stream_joiner", "first_key": "number", "second_key": "number", "second_source": "copy", "time": 5} | changes


BROKEN = {
    "unknown part": lambda job: job.update(extra=1),
    "unknown source_type": lambda job: job["sources"]["calls"].update(source_type="file"),
    "unknown sink_type": lambda job: job["sinks"]["out"].update(sink_type="file"),
    "unknown operator_type": lambda job: job["operators"]["copy"].append({"operator_type": "sort"}),
    "unknown field type": lambda job: job["sources"]["calls"]["schema"].update(number="long"),
    "operators are given for unknown source": lambda job: job["operators"].update(other=[]),
    "missing": lambda job: job["operators"]["calls"][0].pop("key"),
    r"unknown \['size'\]": lambda job: job["operators"]["calls"][0].update(size=1),
    "greater than 0": lambda job: job["operators"]["calls"][0].update(time=0),
    "unknown sink": lambda job: job["operators"]["copy"][0].update(sink="nowhere"),
    "unknown clone": lambda job: job["operators"]["calls"][1].update(clone_name="calls"),
    "published twice": lambda job: job["operators"]["calls"].append({"operator_type": "clone", "clone_name": "copy"}),
    "never published": lambda job: job["operators"]["calls"].pop(1),
    "unknown source 'nowhere'": lambda job: job["operators"]["calls"].append(joiner(second_source="nowhere")),
    "joined with itself": lambda job: job["operators"]["calls"].append(joiner(second_source="calls")),
    "already merged": lambda job: job["operators"]["calls"].extend([joiner(), joiner()]),
    "nothing may follow": lambda job: job["operators"]["copy"].insert(
        0, {"operator_type": "stream_joiner_plug", "main_source": "calls"}
    ),
    "is not merged": lambda job: job["operators"]["copy"].append(
        {"operator_type": "stream_joiner_plug", "main_source": "calls"}
    ),
    "unknown field type 'date'": lambda job: job["operators"]["calls"].append(
        {"operator_type": "field_creator", "field_name": "x", "value": "1", "field_type": "date"}
    ),
}


@pytest.mark.parametrize("message", BROKEN)
def test_broken_jobs(message):
    job = copy.deepcopy(JOB)
    BROKEN[message](job)
    with pytest.raises(ValueError, match=message):
        check_job(job)
