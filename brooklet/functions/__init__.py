from brooklet.functions.casts import as_text, cast_as
from brooklet.functions.expressions import (
    Expression,
    all_truthy,
    any_truthy,
    condition,
    contains,
    equals,
    first_truthy,
    floor_div,
    from_python,
    last_truthy,
    modulo,
    not_truthy,
    replace,
    resolved_type,
    round_half_even,
    slice_text,
    split_get,
    strip,
    to_column,
    truthy,
)
from brooklet.functions.python_text import PythonTextError, is_python_text, python_condition, python_value
from brooklet.functions.rounding import round_float

__all__ = [
    "PythonTextError", "is_python_text", "python_condition", "python_value", "round_float",
    "Expression",
    "all_truthy", "any_truthy", "as_text", "cast_as", "condition", "contains", "equals", "first_truthy", "floor_div",
    "from_python", "last_truthy", "modulo", "not_truthy", "replace", "resolved_type", "round_half_even",
    "slice_text", "split_get", "strip", "to_column", "truthy",
]
