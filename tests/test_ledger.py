"""Exactly-once appends against a database that is played."""

import re

import pytest
from pyspark.sql import functions as F

import workloads
from brooklet.plans import Records
from brooklet.session import work_path
from brooklet.sinks import JdbcStore, Warehouse, append_once
from brooklet.sources import file_records
from brooklet.streaming import Targets, start_job

COLUMNS = {"event_id": "number", "value": "amount"}


class Played:
    """Tables by name, and a ledger; fails where it is told to."""

    def __init__(self, *faults):
        self.tables, self.ledger, self.faults, self.ledgers = {}, {}, list(faults), 0

    def fail(self, place):
        if self.faults and self.faults[0] == place:
            self.faults.pop(0)
            raise ConnectionError(place)

    def stage(self, rows, table):
        self.tables[table] = [tuple(row) for row in rows.collect()]
        self.fail("staged")

    def run(self, statement):
        if statement.startswith("CREATE TABLE IF NOT EXISTS"):
            self.ledgers += 1
        else:
            self.ledger.setdefault(re.search(r"SELECT '((?:[^']|'')*)', -1", statement)[1], -1)

    def transact(self, guard, statements):
        self.fail("before commit")
        batch, query = int(re.search(r"batch = (\d+)", guard)[1]), re.search(r"query = '((?:[^']|'')*)'", guard)[1]
        if self.ledger[query] >= batch:
            return False
        self.ledger[query] = batch
        for statement in statements:
            table, columns, same, staging = re.fullmatch(r"INSERT INTO (\S+) \((.*)\) SELECT (.*) FROM (\S+)", statement).groups()
            assert columns == same == '"number", "amount"'
            self.tables.setdefault(table, []).extend(self.tables[staging])
        self.fail("after commit")
        return True


def test_a_batch_counts_once(spark):
    store = Played()
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5)], "event_id int, value double")
    assert append_once(rows, 0, "it's", "calls", COLUMNS, "done", store)
    assert not append_once(rows, 0, "it's", "calls", COLUMNS, "done", store)
    assert append_once(rows, 1, "it's", "calls", COLUMNS, "done", store)
    assert append_once(rows, 0, "another", "calls", COLUMNS, "done", store)
    assert sorted(store.tables["calls"]) == [(1, 0.5)] * 3 + [(2, 1.5)] * 3
    assert len(store.tables) == 3  # a staging table per query


@pytest.mark.parametrize("faults", [[], ["staged"], ["before commit"], ["after commit"], ["staged", "before commit", "after commit", "after commit"]])
def test_a_job_that_is_started_again_leaves_every_row_once(spark, events, faults):
    path = work_path(spark, "parts")
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    store, name = Played(*faults), f"ledger-{'-'.join(faults).replace(' ', '')}"
    sink = {"sink_type": "greenplum", "address": "h:1", "database": "d", "table": "calls", "schema": COLUMNS}
    chain = [{"operator_type": "field_deleter", "field_name": field} for field in ("event_type", "user_id")]
    job = {"sources": {"events": workloads.kafka_source()}, "sinks": {"out": sink}, "operators": {"events": [*chain, {"operator_type": "output", "sink": "out"}]}}
    for _ in range(len(faults) + 1):
        stream = file_records(spark, path, events.schema, "parquet", streaming=True, files_per_trigger=1)
        queries = start_job(spark, job, name, {"events": Records(stream, "ts", ["event_id"])}, targets=Targets(ledger="done", store=lambda warehouse: store), available_now=True) if not store.faults else None
        if queries is None:
            with pytest.raises(Exception, match=store.faults[0]):
                start_job(spark, job, name, {"events": Records(stream, "ts", ["event_id"])}, targets=Targets(ledger="done", store=lambda warehouse: store), available_now=True)
    assert sorted(store.tables["calls"]) == sorted((row["event_id"], row["value"]) for row in events.collect())
    assert not store.faults and store.ledgers >= 1 and list(store.ledger.values()) == [2]


class Connection:
    def __init__(self, changed, broken=False):
        self.changed, self.broken, self.log = changed, broken, []

    def setAutoCommit(self, on):  # noqa: N802
        self.log.append(f"auto {on}")

    def createStatement(self):  # noqa: N802
        return self

    def executeUpdate(self, statement):  # noqa: N802
        self.log.append(statement)
        if self.broken and statement != "guard":
            raise ConnectionError(statement)
        return self.changed

    def __getattr__(self, name):
        return lambda: self.log.append(name)


@pytest.mark.parametrize(("connection", "log"), [
    (Connection(1), ["auto False", "guard", "a", "b", "commit", "close"]),
    (Connection(0), ["auto False", "guard", "rollback", "close"]),
    (Connection(1, broken=True), ["auto False", "guard", "a", "rollback", "close"]),
])
def test_one_transaction(connection, log):
    store = JdbcStore(Warehouse("h:1", "d", "calls"), lambda: connection)
    if connection.broken:
        with pytest.raises(ConnectionError):
            store.transact("guard", ["a", "b"])
    else:
        assert store.transact("guard", ["a", "b"]) is bool(connection.changed)
    assert connection.log == log
