"""Expressions in Python's notation, as Spark columns with Python's meaning.

``item['string'].split(':')[0]`` is parsed with ``ast`` and every node is
translated to a typed column; nothing is evaluated by Python, neither here nor
on the executors.  The types are those of records (bool, int, float, str) and,
inside an expression, lists of them.  Only the nodes, operators, functions and
methods named below are known; anything else is refused with its place.

Where Python raises, the query fails (division by zero, an index out of range,
``int('x')``), with two exceptions that records need: arithmetic, ordering and
methods on a missing value (None) give a missing value, and whole numbers end
at 64 bits.  ``==``, ``!=``, ``in`` and ``is`` answer for missing values, too.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.functions.casts import number_of, text_of
from brooklet.functions.expressions import floor_div_float, floor_div_whole, modulo
from brooklet.functions.rounding import MAX_DIGITS, round_float, round_whole

RECORD = "item"

# What str.isspace() holds for, as a regular expression class.
SPACES = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

SPARK_TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "str": T.StringType()}
NUMBERS = ("bool", "int", "float")


class PythonTextError(ValueError):
    """An expression that is not understood; names the place."""


@dataclass(frozen=True)
class Value:
    """A translated node: its column and kind.

    Kinds are bool, int, float, str, none, ``list of`` one of these, and truth:
    a mix of kinds of which only the truth is known.  ``constant`` is the
    Python value of a literal.
    """

    column: Column
    kind: str
    constant: object = None

    @property
    def items(self) -> str | None:
        return self.kind.removeprefix("list of ") if self.kind.startswith("list of ") else None


def is_python_text(text: str) -> bool:
    """Whether ``text`` reads as Python about a record: it parses, and names nothing but ``item`` and known functions."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError):
        return False
    names = {node.id for node in ast.walk(tree) if isinstance(node, ast.Name)}
    return RECORD in names and names <= {RECORD, *FUNCTIONS}


def python_condition(text: str, schema: T.StructType) -> Column:
    """``bool(...)`` of the expression for a filter, where null counts as false; plain comparisons stay plain, for the scan."""
    return _Translator(text, schema).condition()


def python_value(text: str, schema: T.StructType) -> Column:
    """The expression's value: a column of bool, bigint, double or string."""
    return _Translator(text, schema).value()


def truth(value: Value) -> Column:
    """What Python takes ``value`` for in a condition."""
    return F.coalesce(_test(value), F.lit(False))


def _test(value: Value) -> Column:
    """As ``truth``, but null for missing values."""
    if value.kind in ("bool", "truth"):
        return value.column
    if value.kind == "none":
        return F.lit(False)
    if value.kind == "str":
        return F.length(value.column) > 0
    if value.items:
        return F.size(value.column) > 0
    return value.column != 0


def _may_fail(node: ast.AST) -> bool:
    """Whether evaluating ``node`` can fail the query, so that it must wait for what stands before it."""
    calls = ("int", "float", "round", "abs")
    return any(
        isinstance(part, (ast.BinOp, ast.UnaryOp))
        or (isinstance(part, ast.Subscript) and not (isinstance(part.value, ast.Name) and part.value.id == RECORD))
        or (isinstance(part, ast.Call) and isinstance(part.func, ast.Name) and part.func.id in calls)
        for part in ast.walk(node)
    )


def _number(value: Value, kind: str) -> Column:
    return value.column if value.kind == kind else value.column.cast(SPARK_TYPES[kind])


def _common(values: Sequence[Value]) -> str | None:
    """The kind that all ``values`` have, missing values apart."""
    kinds = {value.kind for value in values} - {"none"}
    return kinds.pop() if len(kinds) == 1 else None


def _one_or_other(test: Column, yes: Value, no: Value) -> Value:
    kind = _common([yes, no])
    if yes.kind == no.kind == "none":
        return yes
    if kind is None:
        return Value(F.when(test, truth(yes)).otherwise(truth(no)), "truth")
    return Value(F.when(test, yes.column).otherwise(no.column), kind)


class _Translator:
    def __init__(self, text: str, schema: T.StructType):
        self.text, self.schema = text.strip(), schema
        try:
            self.tree = ast.parse(self.text, mode="eval").body
        except (SyntaxError, ValueError) as error:
            raise PythonTextError(f"{self.text!r} is not a Python expression: {error}") from None

    def condition(self, node: ast.AST | None = None) -> Column:
        node = self.tree if node is None else node
        if isinstance(node, ast.BoolOp) and not any(map(_may_fail, node.values[1:])):
            parts = [self.condition(part) for part in node.values]
            return reduce(Column.__and__ if isinstance(node.op, ast.And) else Column.__or__, parts)
        if isinstance(node, ast.Compare):
            return self.links(node, plain=True)
        return _test(self.read(node))

    def value(self) -> Column:
        value = self.read(self.tree)
        if value.kind not in SPARK_TYPES:
            what = "mixes kinds" if value.kind == "truth" else f"is {value.kind}"
            raise self.refusal(self.tree, f"the result {what}; a field is bool, int, float or str")
        return value.column

    def refusal(self, node: ast.AST, what: str) -> PythonTextError:
        return PythonTextError(f"{what}, at column {getattr(node, 'col_offset', 0) + 1} of {self.text!r}")

    def read(self, node: ast.AST) -> Value:
        translate = getattr(self, f"read_{type(node).__name__.lower()}", None)
        if translate is None:
            raise self.refusal(node, f"{type(node).__name__} is not supported")
        return translate(node)

    # --- literals, names and fields

    def read_constant(self, node: ast.Constant) -> Value:
        value = node.value
        if value is None:
            return Value(F.lit(None), "none")
        kind = {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value))
        if kind is None or (kind == "int" and not -(2**63) <= value < 2**63):
            raise self.refusal(node, f"the literal {value!r} is not supported")
        return Value(F.lit(value).cast(SPARK_TYPES[kind]), kind, value)

    def read_name(self, node: ast.Name) -> Value:
        raise self.refusal(node, f"{node.id!r} alone is no value; records are read as {RECORD}['field']")

    def field(self, node: ast.Subscript) -> Value:
        name = node.slice.value if isinstance(node.slice, ast.Constant) else None
        if not isinstance(name, str):
            raise self.refusal(node, "a field is named by a literal text")
        if name not in self.schema.names:
            raise self.refusal(node, f"there is no field {name!r}")
        column, kind = F.col("`" + name.replace("`", "``") + "`"), self.schema[name].dataType
        if isinstance(kind, T.BooleanType):
            return Value(column, "bool")
        if isinstance(kind, T.StringType):
            return Value(column, "str")
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return Value(column.cast("bigint"), "int")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return Value(column.cast("double"), "float")
        raise self.refusal(node, f"field {name!r} is a {kind.simpleString()}, which has no Python kind here")

    def read_list(self, node: ast.List | ast.Tuple) -> Value:
        values = [self.read(item) for item in node.elts]
        kind = _common(values)
        if kind not in SPARK_TYPES or any(value.kind == "none" for value in values):
            raise self.refusal(node, "a list needs items of one kind")
        return Value(F.array(*[value.column for value in values]), f"list of {kind}")

    read_tuple = read_list

    def read_joinedstr(self, node: ast.JoinedStr) -> Value:
        parts = []
        for part in node.values:
            if isinstance(part, ast.FormattedValue):
                if part.format_spec is not None or part.conversion != -1:
                    raise self.refusal(part, "formats are not supported")
                parts.append(self.as_text(part, self.read(part.value)))
            else:
                parts.append(self.read(part).column)
        return Value(F.concat(*parts) if parts else F.lit(""), "str")

    # --- logic

    def read_boolop(self, node: ast.BoolOp) -> Value:
        values = [self.read(item) for item in node.values]
        if isinstance(node.op, ast.And):
            return reduce(lambda rest, left: _one_or_other(truth(left), rest, left), reversed(values[:-1]), values[-1])
        return reduce(lambda rest, left: _one_or_other(truth(left), left, rest), reversed(values[:-1]), values[-1])

    def read_ifexp(self, node: ast.IfExp) -> Value:
        return _one_or_other(truth(self.read(node.test)), self.read(node.body), self.read(node.orelse))

    def read_compare(self, node: ast.Compare) -> Value:
        return Value(self.links(node), "bool")

    def links(self, node: ast.Compare, plain: bool = False) -> Column:
        nodes = [node.left, *node.comparators]
        return reduce(lambda a, b: a & b, [self.compared(node, op, a, b, plain) for op, a, b in zip(node.ops, nodes, nodes[1:])])

    def compared(self, node: ast.Compare, op: ast.cmpop, left: ast.AST, right: ast.AST, plain: bool) -> Column:
        """One comparison; with ``plain`` its result may be null for false."""
        a = self.read(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(right, (ast.List, ast.Tuple)):
                found = reduce(lambda x, y: x | y, [self.equal(node, a, self.read(item)) for item in right.elts], F.lit(False))
            else:
                found = self.inside(node, a, self.read(right))
            return found if isinstance(op, ast.In) else ~found
        b = self.read(right)
        if isinstance(op, (ast.Is, ast.IsNot)):
            if b.kind != "none":
                raise self.refusal(node, "'is' is only supported with None")
            return a.column.isNull() if isinstance(op, ast.Is) else a.column.isNotNull()
        if isinstance(op, ast.Eq):
            return self.equal(node, a, b, plain)
        if isinstance(op, ast.NotEq):
            return ~self.equal(node, a, b)
        first, second = self.alike(node, a, b)
        order: dict[type, Callable] = {ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__}
        return _numbered(order[type(op)](first, second), a, b)

    def alike(self, node: ast.AST, a: Value, b: Value) -> tuple[Column, Column]:
        """Both columns in one type in which they can be ordered."""
        if a.kind in NUMBERS and b.kind in NUMBERS:
            kind = "float" if "float" in (a.kind, b.kind) else "int"
            return _number(a, kind), _number(b, kind)
        if a.kind == b.kind == "str":
            return a.column, b.column
        raise self.refusal(node, f"{a.kind} and {b.kind} have no order")

    def equal(self, node: ast.AST, a: Value, b: Value, plain: bool = False) -> Column:
        if "truth" in (a.kind, b.kind):
            raise self.refusal(node, "a mix of kinds cannot be compared")
        if "none" in (a.kind, b.kind):
            return (a if b.kind == "none" else b).column.isNull()
        if (a.kind in NUMBERS and b.kind in NUMBERS) or a.kind == b.kind == "str":
            left, right = self.alike(node, a, b)
        elif a.items and a.kind == b.kind:
            left, right = a.column, b.column
        elif bool(a.items) != bool(b.items) or a.kind in SPARK_TYPES:
            return a.column.isNull() & b.column.isNull()  # values of different kinds; two missing ones are equal
        else:
            raise self.refusal(node, f"{a.kind} and {b.kind} are not compared")
        literal = a.constant is not None or b.constant is not None
        return _numbered(left == right if plain and literal else left.eqNullSafe(right), a, b)

    def inside(self, node: ast.Compare, a: Value, b: Value) -> Column:
        if a.kind == b.kind == "str":
            return F.contains(b.column, a.column)
        if not b.items:
            raise self.refusal(node, f"{a.kind} in {b.kind} is not supported")
        element = lambda x: self.equal(node, a, Value(x, b.items))
        return F.exists(b.column, element)

    def read_unaryop(self, node: ast.UnaryOp) -> Value:
        value = self.read(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~truth(value), "bool")
        if value.kind not in NUMBERS or isinstance(node.op, ast.Invert):
            raise self.refusal(node, f"{type(node.op).__name__} of {value.kind} is not supported")
        kind = "float" if value.kind == "float" else "int"
        number = _number(value, kind)
        constant = None if value.constant is None else -value.constant if isinstance(node.op, ast.USub) else +value.constant
        return Value(-number if isinstance(node.op, ast.USub) else number, kind, constant)

    # --- arithmetic

    def read_binop(self, node: ast.BinOp) -> Value:
        a, b = self.read(node.left), self.read(node.right)
        op = type(node.op)
        if op is ast.Add and a.kind == b.kind and (a.kind == "str" or a.items):
            return Value(F.concat(a.column, b.column), a.kind)
        if op is ast.Mult and {a.kind, b.kind} == {"str", "int"}:
            text, times = (a, b) if a.kind == "str" else (b, a)
            return Value(F.repeat(text.column, F.greatest(times.column, F.lit(0)).cast("int")), "str")
        if a.kind not in NUMBERS or b.kind not in NUMBERS:
            raise self.refusal(node, f"{op.__name__} of {a.kind} and {b.kind} is not supported")
        kind = "float" if "float" in (a.kind, b.kind) or op is ast.Div else "int"
        left, right = _number(a, kind), _number(b, kind)
        plain: dict[type, Callable] = {ast.Add: Column.__add__, ast.Sub: Column.__sub__, ast.Mult: Column.__mul__, ast.Div: Column.__truediv__}
        if op in plain:
            return Value(plain[op](left, right), kind)
        if op is ast.FloorDiv:
            return Value((floor_div_float if kind == "float" else floor_div_whole)(left, right), kind)
        if op is ast.Mod:
            return Value(modulo(left, right), kind)
        if op is ast.Pow and kind == "int" and isinstance(b.constant, int) and 0 <= b.constant <= 63:
            return Value(reduce(lambda x, _: x * left, range(b.constant), F.lit(1).cast("bigint")), "int")
        raise self.refusal(node, f"{op.__name__} of {a.kind} and {b.kind} is not supported")

    # --- places and parts

    def read_subscript(self, node: ast.Subscript) -> Value:
        if isinstance(node.value, ast.Name) and node.value.id == RECORD:
            return self.field(node)
        value = self.read(node.value)
        if value.kind != "str" and not value.items:
            raise self.refusal(node, f"{value.kind} has no places")
        if isinstance(node.slice, ast.Slice):
            return self.part(node.slice, value)
        place = self.read(node.slice)
        if place.kind not in ("int", "bool"):
            raise self.refusal(node.slice, f"a place is an int, not {place.kind}")
        at = _number(place, "int").cast("int")
        missing = F.raise_error(F.lit(f"IndexError: index out of range in {self.text}"))
        if value.items:
            found, kind = F.when(at < 0, F.try_element_at(value.column, at)).otherwise(F.get(value.column, at)), value.items
            if isinstance(place.constant, int):
                found = F.get(value.column, at) if place.constant >= 0 else F.try_element_at(value.column, at)
        else:
            found, kind = F.substring(value.column, F.when(at < 0, at).otherwise(at + 1), F.lit(1)), "str"
            found = F.when(found != "", found)
        refused = F.when(value.column.isNotNull() & at.isNotNull(), missing.cast(SPARK_TYPES[kind]))
        return Value(F.coalesce(found, refused), kind)

    def part(self, node: ast.Slice, value: Value) -> Value:
        step = self.whole_literal(node.step) if node.step is not None else 1
        if step == -1 and node.lower is None and node.upper is None:
            return Value(F.reverse(value.column), value.kind)
        if step != 1:
            raise self.refusal(node, "of steps only [::-1] is supported")
        size = F.length(value.column) if value.kind == "str" else F.size(value.column)

        def border(bound: ast.AST | None, default: Column) -> Column:
            if bound is None:
                return default
            place = self.read(bound)
            if place.kind == "none":
                return default
            if place.kind not in ("int", "bool"):
                raise self.refusal(bound, f"a border is an int, not {place.kind}")
            at = F.least(F.greatest(_number(place, "int"), F.lit(-(2**31) + 1)), F.lit(2**31 - 1)).cast("int")
            return F.when(at < 0, F.greatest(size + at, F.lit(0))).otherwise(F.least(at, size))

        begin, end = border(node.lower, F.lit(0)), border(node.upper, size)
        cut = F.substring if value.kind == "str" else F.slice
        return Value(cut(value.column, begin + 1, F.greatest(end - begin, F.lit(0))), value.kind)

    # --- functions and methods

    def read_call(self, node: ast.Call) -> Value:
        if node.keywords:
            raise self.refusal(node, "named arguments are not supported")
        if isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS:
            return FUNCTIONS[node.func.id](self, node, [self.read(argument) for argument in node.args])
        if isinstance(node.func, ast.Attribute):
            value = self.read(node.func.value)
            method = METHODS.get(node.func.attr)
            if value.kind != "str" or method is None:
                raise self.refusal(node, f"{value.kind} has no method {node.func.attr!r} here")
            return method(self, node, value, node.args)
        raise self.refusal(node, "this call is not supported")

    def whole_literal(self, node: ast.AST) -> int:
        constant = self.read(node).constant
        if type(constant) is not int:
            raise self.refusal(node, "a literal int is needed")
        return constant

    def text_literal(self, node: ast.AST, empty: bool = False) -> str:
        constant = self.read(node).constant
        if not isinstance(constant, str) or not (constant or empty):
            raise self.refusal(node, "a literal text is needed" + ("" if empty else ", and not an empty one"))
        return constant

    def arguments(self, node: ast.Call, given: Sequence, least: int, most: int) -> None:
        if not least <= len(given) <= most:
            raise self.refusal(node, f"{len(given)} arguments where {least} to {most} are taken")

    def as_text(self, node: ast.AST, value: Value) -> Column:
        if value.kind == "none":
            return F.lit("None")
        if value.kind not in SPARK_TYPES:
            raise self.refusal(node, f"str() of {value.kind} is not supported")
        return text_of(value.column, SPARK_TYPES[value.kind])


def _numbered(test: Column, *values: Value) -> Column:
    """Comparisons with NaN are false."""
    for value in values:
        if value.kind == "float" and value.constant is None:
            test = test & ~F.isnan(value.column)  # true where the value is missing
    return test


# --- functions: (translator, call, arguments) -> value


def _str(t: _Translator, node: ast.Call, args: list[Value]) -> Value:
    t.arguments(node, args, 1, 1)
    return Value(t.as_text(node, args[0]), "str")


def _int(t: _Translator, node: ast.Call, args: list[Value]) -> Value:
    t.arguments(node, args, 1, 1)
    if args[0].kind == "str":
        return Value(number_of(_stripped(args[0].column), T.LongType()), "int")
    return Value(t.number(node, args[0]).column.cast("bigint"), "int")


def _float(t: _Translator, node: ast.Call, args: list[Value]) -> Value:
    t.arguments(node, args, 1, 1)
    if args[0].kind == "str":
        return Value(number_of(_stripped(args[0].column), T.DoubleType()), "float")
    return Value(_number(t.number(node, args[0]), "float"), "float")


def _bool(t: _Translator, node: ast.Call, args: list[Value]) -> Value:
    t.arguments(node, args, 1, 1)
    return Value(truth(args[0]), "bool")


def _len(t: _Translator, node: ast.Call, args: list[Value]) -> Value:
    t.arguments(node, args, 1, 1)
    if args[0].kind == "str":
        return Value(F.length(args[0].column).cast("bigint"), "int")
    if args[0].items:
        return Value(F.size(args[0].column).cast("bigint"), "int")
    raise t.refusal(node, f"{args[0].kind} has no length")


def _abs(t: _Translator, node: ast.Call, args: list[Value]) -> Value:
    t.arguments(node, args, 1, 1)
    kind = "float" if t.number(node, args[0]).kind == "float" else "int"
    return Value(F.abs(_number(args[0], kind)), kind)


def _extreme(before: Callable[[Column, Column], Column]):
    def pick(t: _Translator, node: ast.Call, args: list[Value]) -> Value:
        t.arguments(node, args, 2, 16)
        kind = _common(args)
        if kind not in SPARK_TYPES or any(value.kind == "none" for value in args):
            raise t.refusal(node, "the arguments must be of one kind")
        # As Python goes through them: a later one wins only where it is really smaller (larger); a missing one stays missing.
        best = reduce(lambda a, b: Value(F.when(_numbered(before(b.column, a.column), a, b), b.column).otherwise(a.column), kind), args)
        known = reduce(lambda x, y: x & y, [value.column.isNotNull() for value in args])
        return Value(F.when(known, best.column), kind)

    return pick


def _round(t: _Translator, node: ast.Call, args: list[Value]) -> Value:
    t.arguments(node, args, 1, 2)
    value = t.number(node, args[0])
    digits = t.whole_literal(node.args[1]) if len(args) == 2 else None
    if value.kind == "float":
        if digits is not None and abs(digits) > MAX_DIGITS:
            raise t.refusal(node, f"more than {MAX_DIGITS} digits are not supported")
        rounded = round_float(value.column, digits or 0)
        return Value(rounded, "float") if digits is not None else Value(rounded.cast("bigint"), "int")
    whole = _number(value, "int")
    if digits is None or digits >= 0:
        return Value(whole, "int")
    if digits < -18:
        raise t.refusal(node, "more than 18 digits are not supported")
    return Value(round_whole(whole, 10**-digits), "int")


def _checked(self: _Translator, node: ast.AST, value: Value) -> Value:
    if value.kind not in NUMBERS:
        raise self.refusal(node, f"{value.kind} is no number")
    return value


_Translator.number = _checked

FUNCTIONS: Mapping[str, Callable] = {
    "str": _str, "int": _int, "float": _float, "bool": _bool, "len": _len, "abs": _abs, "round": _round,
    "min": _extreme(Column.__lt__), "max": _extreme(Column.__gt__),
}


# --- methods of texts: (translator, call, text, arguments as nodes) -> value


def _stripped(text: Column, left: bool = True, right: bool = True) -> Column:
    ends = [f"^{SPACES}+"] * left + [f"{SPACES}+$"] * right
    return F.regexp_replace(text, "|".join(ends).replace("$", r"\z"), "")


def _strip(left: bool, right: bool, chars: Callable):
    def strip(t: _Translator, node: ast.Call, text: Value, args: list[ast.AST]) -> Value:
        t.arguments(node, args, 0, 1)
        if args and not (isinstance(args[0], ast.Constant) and args[0].value is None):
            return Value(chars(text.column, F.lit(t.text_literal(args[0]))), "str")
        return Value(_stripped(text.column, left, right), "str")

    return strip


def _split(t: _Translator, node: ast.Call, text: Value, args: list[ast.AST]) -> Value:
    t.arguments(node, args, 0, 2)
    if not args or (isinstance(args[0], ast.Constant) and args[0].value is None):
        t.arguments(node, args, 0, 1)
        parts = F.split(text.column, f"{SPACES}+")
        return Value(F.filter(parts, lambda part: part != ""), "list of str")
    limit = t.whole_literal(args[1]) if len(args) == 2 else -1
    separator = re.escape(t.text_literal(args[0]))
    return Value(F.split(text.column, separator, limit + 1 if limit >= 0 else -1), "list of str")


def _replace(t: _Translator, node: ast.Call, text: Value, args: list[ast.AST]) -> Value:
    t.arguments(node, args, 2, 2)
    new = t.read(args[1])
    if new.kind != "str":
        raise t.refusal(args[1], f"a text is needed, not {new.kind}")
    return Value(F.replace(text.column, F.lit(t.text_literal(args[0])), new.column), "str")


def _at_end(test: Callable[[Column, Column], Column]):
    def check(t: _Translator, node: ast.Call, text: Value, args: list[ast.AST]) -> Value:
        t.arguments(node, args, 1, 1)
        options = args[0].elts if isinstance(args[0], ast.Tuple) else [args[0]]
        parts = [t.read(option) for option in options]
        if not parts or any(part.kind != "str" for part in parts):
            raise t.refusal(args[0], "a text or several are needed")
        return Value(reduce(lambda a, b: a | b, [test(text.column, part.column) for part in parts]), "bool")

    return check


def _find(t: _Translator, node: ast.Call, text: Value, args: list[ast.AST]) -> Value:
    t.arguments(node, args, 1, 1)
    return Value((F.instr(text.column, t.text_literal(args[0], empty=True)) - 1).cast("bigint"), "int")


def _times(t: _Translator, node: ast.Call, text: Value, args: list[ast.AST]) -> Value:
    t.arguments(node, args, 1, 1)
    part = t.text_literal(args[0])
    without = F.length(F.replace(text.column, F.lit(part), F.lit("")))
    return Value(F.call_function("div", F.length(text.column) - without, F.lit(len(part))).cast("bigint"), "int")


def _join(t: _Translator, node: ast.Call, text: Value, args: list[ast.AST]) -> Value:
    t.arguments(node, args, 1, 1)
    parts = t.read(args[0])
    if parts.items != "str":
        raise t.refusal(args[0], f"a list of texts is needed, not {parts.kind}")
    return Value(F.array_join(parts.column, t.text_literal(node.func.value, empty=True)), "str")


def _plain(function: Callable[[Column], Column]):
    def apply(t: _Translator, node: ast.Call, text: Value, args: list[ast.AST]) -> Value:
        t.arguments(node, args, 0, 0)
        return Value(function(text.column), "str")

    return apply


METHODS: Mapping[str, Callable] = {
    "split": _split, "replace": _replace, "join": _join, "find": _find, "count": _times,
    "strip": _strip(True, True, F.btrim), "lstrip": _strip(True, False, F.ltrim), "rstrip": _strip(False, True, F.rtrim),
    "lower": _plain(F.lower), "upper": _plain(F.upper),
    "startswith": _at_end(F.startswith), "endswith": _at_end(F.endswith),
}
