"""The Python meaning of operations as SQL functions, so that declared jobs can use it.

Spark replaces a call by the function's body while it plans the query: no Python
runs.  Arguments are typed, so whole and floating numbers have functions of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_REST = "CASE WHEN a % b = 0 THEN IF(b < 0, -abs(a % b), abs(a % b)) WHEN (a % b < 0) <> (b < 0) THEN a % b + b ELSE a % b END"
_EXACT = f"((a - ({_REST})) / b)"
_DIGITS = "regexp_replace(text, r'(?<=[0-9])_(?=[0-9])', '')"
_PARTS = r"split(text, concat(r'\Q', separator, r'\E'))"

# name: (parameters, result, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "py_mod": ("a BIGINT, b BIGINT", "BIGINT", _REST),
    "py_fmod": ("a DOUBLE, b DOUBLE", "DOUBLE", _REST),
    "py_floordiv": (
        "a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a % b <> 0 AND (a % b < 0) <> (b < 0) THEN (a DIV b) - 1 ELSE a DIV b END",
    ),
    "py_ffloordiv": (
        "a DOUBLE, b DOUBLE", "DOUBLE",
        f"CASE WHEN abs({_EXACT}) >= 9007199254740992D THEN {_EXACT}"
        f" WHEN {_EXACT} - floor({_EXACT}) > 0.5D THEN floor({_EXACT}) + 1D ELSE CAST(floor({_EXACT}) AS DOUBLE) END",
    ),
    "py_round": ("a DOUBLE", "BIGINT", "CAST(bround(a, 0) AS BIGINT)"),
    "py_int": ("text STRING", "INT", f"CAST({_DIGITS} AS INT)"),
    "py_float": (
        "text STRING", "DOUBLE",
        f"CAST(CASE WHEN text RLIKE r'[0-9.][dDfF]\\s*$' THEN raise_error(concat('could not convert to double: ', text)) ELSE {_DIGITS} END AS DOUBLE)",
    ),
    "py_bool_str": ("a BOOLEAN", "STRING", "CASE WHEN a THEN 'True' WHEN NOT a THEN 'False' ELSE 'None' END"),
    "py_split": (
        "text STRING, separator STRING, place INT", "STRING",
        f"IF(place >= 0, get({_PARTS}, place), try_element_at({_PARTS}, IF(place >= 0, 1, place)))",
    ),
    "py_slice": (
        "text STRING, start INT, stop INT", "STRING",
        "substring(text, "
        "CASE WHEN start IS NULL THEN 0 WHEN start >= 0 THEN least(start, length(text)) ELSE greatest(length(text) + start, 0) END + 1, "
        "greatest(0, CASE WHEN stop IS NULL THEN length(text) WHEN stop >= 0 THEN least(stop, length(text)) ELSE greatest(length(text) + stop, 0) END"
        " - CASE WHEN start IS NULL THEN 0 WHEN start >= 0 THEN least(start, length(text)) ELSE greatest(length(text) + start, 0) END))",
    ),
    "py_strip": ("text STRING", "STRING", r"regexp_replace(text, r'(?U)^\s+|\s+$', '')"),
    "py_in": ("part STRING, text STRING", "BOOLEAN", "contains(text, part)"),
    "truthy": ("a DOUBLE", "BOOLEAN", "coalesce(a <> 0, false)"),
    "truthy_text": ("a STRING", "BOOLEAN", "coalesce(length(a) > 0, false)"),
    "py_or": ("a STRING, b STRING", "STRING", "IF(coalesce(length(a) > 0, false), a, b)"),
    "py_and": ("a STRING, b STRING", "STRING", "IF(coalesce(length(a) > 0, false), b, a)"),
    "py_number_or": ("a DOUBLE, b DOUBLE", "DOUBLE", "IF(coalesce(a <> 0, false), a, b)"),
    "py_number_and": ("a DOUBLE, b DOUBLE", "DOUBLE", "IF(coalesce(a <> 0, false), b, a)"),
}

# What SQL reads without complaint, but in another sense than Python.
OTHER_MEANING = {r"%": "py_mod or py_fmod", r"\bround\s*\(": "py_round", r"\bfloat\s*\(": "py_float"}


def register_functions(spark: SparkSession) -> None:
    """Define the functions in the session; they are temporary and hide nothing of Spark's own."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def check_meaning(label: str, expression: str) -> None:
    """Refuse what would silently differ from Python: its remainder, its rounding, and its 64-bit float."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", expression)
    for pattern, instead in OTHER_MEANING.items():
        if re.search(pattern, bare, re.IGNORECASE):
            raise ValueError(f"{label}: SQL and Python differ on {pattern.strip(chr(92) + 'bs*(')!r} in {expression!r}; use {instead}")
