"""Exactly-once appends of micro-batches to a warehouse table.

A micro-batch may be tried again after a failure.  Its rows therefore go to a
staging table first, which each try replaces; then one transaction moves the
batch number of the query in a ledger table forward and copies the staged rows.
A batch that is in the ledger already changes nothing: its transaction is rolled
back.  The query is told apart by the identifier Spark keeps in the checkpoint,
so a new checkpoint, whose numbers begin again, does not count as a repetition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame

from brooklet.sinks.warehouse import Warehouse, table_columns


class Store(Protocol):
    """What an exactly-once append needs from a database."""

    def stage(self, rows: DataFrame, table: str) -> None:
        """Replace ``table`` by ``rows``."""

    def transact(self, guard: str, statements: Sequence[str]) -> bool:
        """Run ``guard``; if it changed a row also ``statements``, and commit all; else roll back and answer False."""

    def run(self, statement: str) -> None:
        """Run one statement on its own."""


@dataclass(frozen=True)
class JdbcStore:
    """A database over JDBC: tasks write the staging table, one connection of the driver commits.

    ``connect`` opens a java.sql.Connection; by default through Spark's JVM.
    """

    warehouse: Warehouse
    connect: Callable[[], Any] | None = None

    def stage(self, rows: DataFrame, table: str) -> None:
        rows.write.format("jdbc").options(**self.warehouse.options() | {"dbtable": table, "truncate": "true"}).mode("overwrite").save()

    def transact(self, guard: str, statements: Sequence[str]) -> bool:
        connection = self._open()
        try:
            connection.setAutoCommit(False)
            done = False
            try:
                if connection.createStatement().executeUpdate(guard):
                    for statement in statements:
                        connection.createStatement().executeUpdate(statement)
                    connection.commit()
                    done = True
            finally:
                if not done:
                    connection.rollback()
            return done
        finally:
            connection.close()

    def run(self, statement: str) -> None:
        connection = self._open()
        try:
            connection.createStatement().executeUpdate(statement)
        finally:
            connection.close()

    def _open(self) -> Any:
        if self.connect is not None:
            return self.connect()
        from pyspark.sql import SparkSession

        jvm, options = SparkSession.active()._jvm, self.warehouse.options()
        jvm.java.lang.Class.forName(options["driver"])
        return jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user"), options.get("password"))


def ledger_setup(ledger: str) -> str:
    """The statement that makes the ledger table where there is none."""
    return f"CREATE TABLE IF NOT EXISTS {ledger} (query varchar(200) PRIMARY KEY, batch bigint NOT NULL)"


def query_id(df: DataFrame) -> str:
    """The identifier of the streaming query that runs; it is kept in the checkpoint."""
    found = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if found is None:
        raise ValueError("exactly-once appends need a streaming query")
    return found


def append_once(df: DataFrame, batch: int, query: str, table: str, columns: Mapping[str, str], ledger: str, store: Store) -> bool:
    """Append the rows of batch number ``batch`` of ``query`` once, however often it is tried; False where they were there."""
    rows = table_columns(df, columns)
    staging = f"{table}__{hashlib.sha1(query.encode()).hexdigest()[:12]}"
    store.stage(rows, staging)
    name = "'" + query.replace("'", "''") + "'"
    # The row stands before the transaction, so that two drivers of one query wait for each other on it.
    store.run(f"INSERT INTO {ledger} (query, batch) SELECT {name}, -1 WHERE NOT EXISTS (SELECT 1 FROM {ledger} WHERE query = {name})")
    listed = ", ".join('"' + column.replace('"', '""') + '"' for column in rows.columns)
    guard = f"UPDATE {ledger} SET batch = {batch} WHERE query = {name} AND batch < {batch}"
    return store.transact(guard, [f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging}"])
