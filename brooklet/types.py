"""The four field types a declared record schema can use, as Spark types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import types as T

# The type names a job spec may use.
FIELD_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def field_type(name: str) -> T.DataType:
    """Spark type for one of the four declared type names."""
    try:
        return FIELD_TYPES[name]
    except KeyError:
        raise ValueError(f"unknown field type {name!r}; expected one of {sorted(FIELD_TYPES)}") from None


def record_schema(fields: Mapping[str, str]) -> T.StructType:
    """StructType of a declared ``{field: type name}`` map, fields in alphabetical order."""
    return T.StructType([T.StructField(name, field_type(fields[name])) for name in sorted(fields)])


def type_name(data_type: T.DataType) -> str | None:
    """Declared name of a Spark type, or None for types outside the four."""
    return next((name for name, known in FIELD_TYPES.items() if known == data_type), None)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)
