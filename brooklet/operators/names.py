"""Field names, whatever characters they have, and the order of rows that name no order themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the library's own columns begin with this; fields of records must not.
HIDDEN = "__"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(name: str) -> Column:
    """The column called ``name``, which may hold dots."""
    return F.col(quoted(name))


def fields(df: DataFrame) -> list[Column]:
    return [field(name) for name in df.columns]


def present_name(df: DataFrame, name: str) -> str | None:
    """The column that Spark takes ``name`` for: it may differ in case unless the session is case sensitive."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return name if name in df.columns else None
    return next((column for column in df.columns if column.lower() == name.lower()), None)


def total_order(df: DataFrame, tiebreak: Sequence[str]) -> list[Column]:
    """``tiebreak``, then two hashes of the whole row: rows equal in all of these are copies of each other.

    The order of rows with equal key and time is then the same in every plan,
    in batches and in streams, also where ``tiebreak`` does not tell them apart.
    """
    row = [F.to_json(F.struct(field(f.name))) if _has_map(f.dataType) else field(f.name) for f in df.schema]
    return [*map(field, tiebreak), F.xxhash64(*row), F.xxhash64(F.lit("second"), *row)]


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()
