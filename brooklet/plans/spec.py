"""The declarative job format: sources, sinks and one chain of operators per source.

A job is a plain dict, loaded from JSON or YAML.  ``check_job`` verifies what
can be said without data; field names, types and expressions are verified when
the chains are turned into DataFrames.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from brooklet.functions.python_text import is_python_text
from brooklet.functions.sql import check_meaning
from brooklet.operators.names import HIDDEN
from brooklet.types import field_type

# The words of the job format, and the parameters each kind takes (required, optional).
SOURCES = {
    "kafka": (("address", "topic", "schema"), ()),
    "clone": (("source",), ()),
}
SINKS = {
    "kafka": (("address", "topic"), ()),
    "greenplum": (("address", "database", "table", "schema"), ("init_sql",)),
    "minio": (("address",), ("title_field",)),
}
OPERATORS = {
    "deduplicator": (("key", "time"), ()),
    "filter": (("expression",), ()),
    "output": (("sink",), ()),
    "clone": (("clone_name",), ()),
    "field_deleter": (("field_name",), ()),
    "field_changer": (("field_name", "value"), ("new_type",)),
    "field_creator": (("field_name", "value", "field_type"), ()),
    "field_enricher": (("field_name", "search_key"), ()),
    "stream_joiner": (("first_key", "second_key", "second_source", "time"), ()),
    "stream_joiner_plug": (("main_source",), ()),
}
SETTINGS = ((), ("parallelism", "min_pause_between_checkpoints", "checkpoint_interval", "rows_per_trigger"))
CHECKPOINT_INTERVAL_MS = 30_000

Job = dict[str, Any]


def load_json(text: str) -> Job:
    return check_job(json.loads(text))


def dump_json(job: Job) -> str:
    return json.dumps(job, ensure_ascii=False, indent=2)


def load_yaml(text: str) -> Job:
    import yaml

    return check_job(yaml.safe_load(text))


def dump_yaml(job: Job) -> str:
    import yaml

    return yaml.safe_dump(job, allow_unicode=True, sort_keys=False)


def check_job(job: Job) -> Job:
    """The job itself, or ValueError with the first rule it breaks."""
    unknown = set(job) - {"settings", "sources", "sinks", "operators"}
    if unknown:
        raise ValueError(f"unknown part of a job: {sorted(unknown)}")
    sources, sinks, chains = (job.get(part) or {} for part in ("sources", "sinks", "operators"))
    _check_parameters("settings", job.get("settings") or {}, SETTINGS)
    for name, source in sources.items():
        _check_kind(f"source {name!r}", source, "source_type", SOURCES)
        for field, kind in source.get("schema", {}).items():
            field_type(kind)
            _check_field(f"source {name!r}", field)
    for name, sink in sinks.items():
        _check_kind(f"sink {name!r}", sink, "sink_type", SINKS)
    for name, chain in chains.items():
        if name not in sources:
            raise ValueError(f"operators are given for unknown source {name!r}")
        for index, operator in enumerate(chain):
            label = f"operator {name}:{index}"
            _check_kind(label, operator, "operator_type", OPERATORS)
            _check_references(label, name, operator, sources, sinks)
            if operator["operator_type"] == "stream_joiner_plug" and index != len(chain) - 1:
                raise ValueError(f"{label}: nothing may follow the end of a merged chain")
    _check_clones(sources, chains)
    _check_merges(chains)
    return job


def _check_kind(label: str, part: Mapping, tag: str, kinds: Mapping) -> None:
    if part.get(tag) not in kinds:
        raise ValueError(f"{label}: unknown {tag} {part.get(tag)!r}")
    _check_parameters(label, {name: value for name, value in part.items() if name != tag}, kinds[part[tag]])


def _check_parameters(label: str, given: Mapping, allowed: tuple) -> None:
    required, optional = allowed
    missing = [name for name in required if given.get(name) is None]
    extra = sorted(set(given) - set(required) - set(optional))
    if missing or extra:
        raise ValueError(f"{label}: missing {missing}, unknown {extra}")


def _check_field(label: str, field: str) -> None:
    if field.startswith(HIDDEN):
        raise ValueError(f"{label}: names that begin with {HIDDEN!r} are taken, {field!r} is one")


def _check_references(label: str, source: str, operator: Mapping, sources: Mapping, sinks: Mapping) -> None:
    if "time" in operator and operator["time"] <= 0:
        raise ValueError(f"{label}: the time must be greater than 0")
    for parameter in ("expression", "value", "search_key"):
        if isinstance(operator.get(parameter), str) and not is_python_text(operator[parameter]):
            check_meaning(label, operator[parameter])
    if operator["operator_type"] in ("field_creator", "field_enricher"):
        _check_field(label, operator["field_name"])
    for parameter in ("field_type", "new_type"):
        if operator.get(parameter) is not None:
            field_type(operator[parameter])
    if "sink" in operator and operator["sink"] not in sinks:
        raise ValueError(f"{label}: unknown sink {operator['sink']!r}")
    if "second_source" in operator:
        if operator["second_source"] not in sources:
            raise ValueError(f"{label}: unknown source {operator['second_source']!r}")
        if operator["second_source"] == source:
            raise ValueError(f"{label}: a source cannot be joined with itself; clone it first")


def _check_clones(sources: Mapping, chains: Mapping) -> None:
    published: dict[str, str] = {}
    for name, chain in chains.items():
        for operator in chain:
            if operator["operator_type"] == "clone":
                clone = operator["clone_name"]
                if sources.get(clone, {}).get("source_type") != "clone":
                    raise ValueError(f"unknown clone {clone!r}")
                if clone in published:
                    raise ValueError(f"clone {clone!r} is published twice")
                if sources[clone]["source"] != name:
                    raise ValueError(f"clone {clone!r} belongs to {sources[clone]['source']!r}, not to {name!r}")
                published[clone] = name
    for name, source in sources.items():
        if source["source_type"] == "clone" and name not in published:
            raise ValueError(f"clone {name!r} is never published by {source['source']!r}")


def _check_merges(chains: Mapping) -> None:
    merged: dict[str, str] = {}
    for name, chain in chains.items():
        for operator in chain:
            if operator["operator_type"] == "stream_joiner":
                second = operator["second_source"]
                if second in merged:
                    raise ValueError(f"source {second!r} is already merged into {merged[second]!r}")
                merged[second] = name
    for name, chain in chains.items():
        if chain and chain[-1]["operator_type"] == "stream_joiner_plug" and merged.get(name) != chain[-1]["main_source"]:
            raise ValueError(f"source {name!r} is not merged into {chain[-1]['main_source']!r}")
