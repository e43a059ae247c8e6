"""Python-flavoured scalar expressions as plain Spark columns.

Record expressions are Spark SQL strings or Columns.  The helpers here keep the
Python meaning where Spark's operator of the same name differs: truthiness,
floor division, modulo, text splitting, stripping and slicing.  All of them are
built from JVM functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.functions.rounding import round_float
from brooklet.types import field_type, is_numeric

Expression = str | Column


def to_column(expression: Expression) -> Column:
    """Accept a SQL string or a Column."""
    return F.expr(expression) if isinstance(expression, str) else expression


def resolved_type(df: DataFrame, expression: Expression) -> T.DataType:
    """Type the analyzer gives ``expression`` over ``df``; invalid expressions raise here."""
    return df.select(to_column(expression).alias("v")).schema["v"].dataType


def condition(df: DataFrame, expression: Expression) -> Column:
    """Truth test for a filter: null counts as false there, so a plain comparison stays one.

    That lets simple conditions reach the scan.
    """
    column = to_column(expression)
    kind = resolved_type(df, expression)
    if isinstance(kind, T.BooleanType):
        return column
    if is_numeric(kind):
        return column != F.lit(0)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.length(column) > 0
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(column) > 0
    return column.isNotNull()


def truthy(df: DataFrame, expression: Expression) -> Column:
    """Non-null boolean column: would Python take the value as true?"""
    return F.coalesce(condition(df, expression), F.lit(False))


def all_truthy(df: DataFrame, *expressions: Expression) -> Column:
    """``a and b and ...`` used as a condition."""
    result = F.lit(True)
    for expression in expressions:
        result = result & truthy(df, expression)
    return result


def any_truthy(df: DataFrame, *expressions: Expression) -> Column:
    """``a or b or ...`` used as a condition."""
    result = F.lit(False)
    for expression in expressions:
        result = result | truthy(df, expression)
    return result


def not_truthy(df: DataFrame, expression: Expression) -> Column:
    """``not a``."""
    return ~truthy(df, expression)


def first_truthy(df: DataFrame, left: Expression, right: Expression) -> Column:
    """``left or right`` used as a value: the left operand when it is truthy, else the right one."""
    return F.when(truthy(df, left), to_column(left)).otherwise(to_column(right))


def last_truthy(df: DataFrame, left: Expression, right: Expression) -> Column:
    """``left and right`` used as a value: the right operand when the left one is truthy, else the left one."""
    return F.when(truthy(df, left), to_column(right)).otherwise(to_column(left))


def equals(left: Expression, right: Expression) -> Column:
    """``==`` that answers true or false for nulls too."""
    return to_column(left).eqNullSafe(to_column(right))


def modulo(left: Expression, right: Expression) -> Column:
    """``%`` whose result takes the sign of the divisor."""
    a, b = to_column(left), to_column(right)
    rest = a % b
    zero = F.when(b < 0, -F.abs(rest)).otherwise(F.abs(rest))  # a float zero takes the divisor's sign, too
    return F.when(rest == 0, zero).when((rest < 0) != (b < 0), rest + b).otherwise(rest)


def floor_div(df: DataFrame, left: Expression, right: Expression) -> Column:
    """``//``: rounds towards minus infinity; integers stay integers."""
    a, b = to_column(left), to_column(right)
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(resolved_type(df, left), integral) and isinstance(resolved_type(df, right), integral):
        return floor_div_whole(a, b)
    return floor_div_float(a.cast("double"), b.cast("double"))


def floor_div_whole(a: Column, b: Column) -> Column:
    # Divided first: taking the remainder off first could leave the range of the type.
    rest, whole = a % b, F.call_function("div", a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), whole - 1).otherwise(whole)


def floor_div_float(a: Column, b: Column) -> Column:
    # The remainder is taken off first, so that 1.0 // 0.1 is 9.0 and not floor(10.0).
    exact = (a - modulo(a, b)) / b
    whole = F.floor(exact).cast("double")
    nearest = F.when(exact - whole > 0.5, whole + 1.0).otherwise(whole)
    signed = F.when(nearest == 0, a / b * F.lit(0.0)).otherwise(nearest)  # a zero has the quotient's sign
    return F.when(F.abs(exact) >= F.lit(2.0**53), exact).otherwise(signed)


def split_get(text: Expression, separator: str, index: int) -> Column:
    """``text.split(separator)[index]``; null where there is no such part."""
    parts = F.split(to_column(text), re.escape(separator))
    if index >= 0:
        return F.get(parts, F.lit(index))
    return F.try_element_at(parts, F.lit(index))


def strip(text: Expression) -> Column:
    """``text.strip()``: all leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(to_column(text), r"(?U)^\s+|\s+$", "")


def slice_text(text: Expression, start: int | None = None, stop: int | None = None) -> Column:
    """``text[start:stop]`` with Python's zero-based and negative positions."""
    column = to_column(text)
    size = F.length(column)

    def position(offset: int) -> Column:
        return F.least(F.lit(offset), size) if offset >= 0 else F.greatest(size + F.lit(offset), F.lit(0))

    begin = position(start or 0)
    end = size if stop is None else position(stop)
    return F.substring(column, begin + 1, F.greatest(end - begin, F.lit(0)))


def contains(text: Expression, part: Expression) -> Column:
    """``part in text`` for strings."""
    return F.contains(to_column(text), to_column(part))


def replace(text: Expression, old: str, new: str) -> Column:
    """``text.replace(old, new)``: every occurrence, taken literally."""
    return F.replace(to_column(text), F.lit(old), F.lit(new))


def round_half_even(number: Expression, digits: int = 0) -> Column:
    """``round(number, digits)`` of a float: halves of its binary value go to the even neighbour.  Whole results have no signed zero."""
    rounded = round_float(to_column(number).cast("double"), digits)
    return rounded if digits else rounded + F.lit(0.0)


def from_python(function: Callable, returns: str, *fields: str) -> Column:
    """Escape hatch: a vectorised Python function over the named fields only.

    ``function`` takes one pandas Series per field and returns a Series; the
    batches cross to Python over Arrow.
    """
    return F.pandas_udf(function, field_type(returns))(*[F.col(name) for name in fields])
