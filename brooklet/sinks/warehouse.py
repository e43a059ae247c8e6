"""Append to a table of a PostgreSQL-compatible warehouse over JDBC."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How often, and how many seconds apart, the table set-up is tried.
INIT_TRIES = 100
INIT_PAUSE = 1.0


@dataclass(frozen=True)
class Warehouse:
    """Where the table lives; credentials come from the caller."""

    address: str
    database: str
    table: str
    user: str | None = None
    password: str | None = None
    connections: int = 32

    @property
    def url(self) -> str:
        return f"jdbc:postgresql://{self.address}/{self.database}"

    def options(self) -> dict[str, str]:
        options = {
            "url": self.url,
            "dbtable": self.table,
            "driver": "org.postgresql.Driver",
            # Upper bound of parallel connections, whatever the number of partitions.
            "numPartitions": str(self.connections),
            "batchsize": "10000",
        }
        if self.user is not None:
            options["user"] = self.user
        if self.password is not None:
            options["password"] = self.password
        return options


def table_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Fields of ``df`` under their table names, ordered by field name."""
    return df.select([F.col(field).alias(columns[field]) for field in sorted(columns)])


def append_rows(df: DataFrame, warehouse: Warehouse, columns: Mapping[str, str]) -> None:
    """Insert the rows of a batch DataFrame (needs the database's JDBC driver jar)."""
    table_columns(df, columns).write.format("jdbc").options(**warehouse.options()).mode("append").save()


def count_rows(spark: SparkSession, warehouse: Warehouse) -> int:
    """Number of rows in the table; the count itself runs in the database."""
    return spark.read.format("jdbc").options(**warehouse.options()).load().count()


def run_init(
    execute: Callable[[], None],
    transient: type[Exception] | tuple[type[Exception], ...] = ConnectionError,
    tries: int = INIT_TRIES,
    pause: float = INIT_PAUSE,
) -> None:
    """Run the set-up statement through ``execute`` until the database answers.

    Only ``transient`` errors are tried again; the last one is raised.
    """
    for attempt in range(1, tries + 1):
        try:
            return execute()
        except transient:
            if attempt == tries:
                raise
            time.sleep(pause)
