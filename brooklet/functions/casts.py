"""Casts to the four field types with Python's conversion rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.functions.expressions import Expression, resolved_type, to_column, truthy
from brooklet.session import require_ansi
from brooklet.types import field_type


def cast_as(df: DataFrame, expression: Expression, target: str | T.DataType) -> Column:
    """``expression`` converted to one of the four types, or to any other Spark type by a plain cast.

    Values that Python refuses (``int('1.5')``) fail the query; nulls stay null
    except in text, where they become ``'None'``.
    """
    wanted = field_type(target) if isinstance(target, str) else target
    if isinstance(wanted, T.BooleanType):
        return truthy(df, expression)
    if isinstance(wanted, T.StringType):
        return as_text(df, expression)
    require_ansi(df.sparkSession)
    column, kind = to_column(expression), resolved_type(df, expression)
    if isinstance(kind, T.StringType):
        if isinstance(wanted, (T.IntegerType, T.DoubleType)):
            return number_of(column, wanted)
    return column.cast(wanted)


def as_text(df: DataFrame, expression: Expression) -> Column:
    """``str(value)``."""
    return text_of(to_column(expression), resolved_type(df, expression))


def text_of(column: Column, kind: T.DataType) -> Column:
    """``str(value)`` of a column of a known type."""
    if isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, F.lit("True")).otherwise(F.when(~column, F.lit("False")))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _float_text(column.cast("double"))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("None"))


def number_of(text: Column, wanted: T.DataType) -> Column:
    """``int(text)`` or ``float(text)``, by the wanted type; what Python refuses fails the query."""
    digits = _digits(text)
    return (_checked_number(digits) if isinstance(wanted, T.DoubleType) else digits).cast(wanted)


def _digits(text: Column) -> Column:
    """Drop the single underscores Python allows between digits."""
    return F.when(F.contains(text, F.lit("_")), F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")).otherwise(text)


def _checked_number(text: Column) -> Column:
    """Refuse the type suffixes (``1.0d``) the JVM would accept."""
    return F.when(
        F.rlike(text, F.lit(r"[0-9.][dDfF]\s*$")),
        F.raise_error(F.concat(F.lit("could not convert to double: "), text)).cast("string"),
    ).otherwise(text)


def _float_text(value: Column) -> Column:
    """Shortest decimal text: positional from 1e-4 up to 1e16, scientific outside."""
    text, size = value.cast("string"), F.abs(value)
    ready = ((size >= 1e-3) & (size < 1e7) & (F.length(text) < 18)) | (value == 0)
    # One entry for what needs work, none for the rest: a transform computes it once, and only there.
    hard = F.when(ready | F.isnan(value) | (size == float("inf")), F.array().cast("array<string>")).otherwise(F.array(_shortest(value, text)))
    written = F.transform(hard, lambda digits: F.when((size >= 1e-4) & (size < 1e16), _positional(digits)).otherwise(_scientific(digits)))
    return (
        F.when(ready, text)
        .when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .otherwise(F.get(written, F.lit(0)))
    )


def _positional(digits: Column) -> Column:
    """38 digits hold every positional value exactly; its trailing zeros go, but for one after the point."""
    trimmed = F.rtrim(digits.cast("decimal(38,21)").cast("string"), F.lit("0"))
    return F.when(F.endswith(trimmed, F.lit(".")), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def _scientific(digits: Column) -> Column:
    """``1.50E7`` as ``1.5e+07``: no zeros or point to spare before the e, a sign and two places behind it."""
    parts = F.split(F.upper(digits), "E")
    number = F.rtrim(F.rtrim(F.get(parts, F.lit(0)), F.lit("0")), F.lit("."))
    power = F.get(parts, F.lit(1)).cast("int")
    places = F.abs(power).cast("string")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(number, F.lit("e"), sign, F.when(F.length(places) < 2, F.lit("0")).otherwise(F.lit("")), places)


def _shortest(value: Column, text: Column) -> Column:
    """The fewest digits that give ``value`` back; older JVMs print up to two digits too many."""
    tries = F.transform(F.array(F.lit("%.14e"), F.lit("%.15e"), F.lit("%.16e")), lambda form: F.printf(form, value))
    fitting = F.filter(tries, lambda digits: digits.cast("double") == value)
    return F.when(F.length(text) >= 18, F.get(fitting, F.lit(0))).otherwise(text)
