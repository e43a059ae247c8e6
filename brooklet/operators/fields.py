"""Per-row operators: filter, create, change and delete a field.

Each is one projection or filter, valid on batch and streaming DataFrames.
Nothing is shuffled, and simple predicates and unused columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from brooklet.functions import Expression, cast_as, condition
from brooklet.operators.names import present_name


def filter_rows(df: DataFrame, expression: Expression) -> DataFrame:
    """Keep the rows on which ``expression`` is truthy."""
    return df.filter(condition(df, expression))


def create_field(df: DataFrame, name: str, value: Expression, field_type: str) -> DataFrame:
    """Add field ``name`` = ``value`` cast to ``field_type``; the field must be new."""
    require_absent(df, name)
    return df.withColumn(name, cast_as(df, value, field_type))


def change_field(df: DataFrame, name: str, value: Expression, new_type: str | None = None) -> DataFrame:
    """Overwrite field ``name``; ``value`` sees the old content.

    The result is cast to ``new_type``, or to the field's present type.
    """
    require_present(df, name)
    return df.withColumn(name, cast_as(df, value, new_type or df.schema[name].dataType))


def delete_field(df: DataFrame, name: str) -> DataFrame:
    """Remove an existing field."""
    require_present(df, name)
    return df.drop(name)


def require_present(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"field {name!r} is not in the schema {df.columns}")


def require_absent(df: DataFrame, name: str) -> None:
    known = present_name(df, name)
    if known is not None:
        raise ValueError(f"field {name!r} is already in the schema" + (f" as {known!r}" if known != name else ""))
