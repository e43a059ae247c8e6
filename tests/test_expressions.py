import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brooklet import functions as bf
from brooklet.operators import change_field, create_field, delete_field, filter_rows
from brooklet.types import field_type, record_schema, type_name


def values(df, column):
    return [row[0] for row in df.select(column.alias("v")).collect()]


TRUTH = {
    "boolean": [True, False, None],
    "int": [0, 1, -1, None],
    "double": [0.0, -0.0, 0.5, float("nan"), None],
    "string": ["", "False", " ", None],
    "array<int>": [[], [0], None],
}


@pytest.mark.parametrize("kind", TRUTH)
def test_truthiness(spark, kind):
    df = spark.createDataFrame([(value,) for value in TRUTH[kind]], f"v {kind}")
    assert values(df, bf.truthy(df, "v")) == [bool(value) for value in TRUTH[kind]]
    assert values(df, bf.not_truthy(df, "v")) == [not value for value in TRUTH[kind]]
    assert filter_rows(df, "v").count() == sum(map(bool, TRUTH[kind]))


def test_and_or_give_operands(spark):
    rows = [("", "x"), ("a", "x"), ("a", ""), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert values(df, bf.first_truthy(df, "a", "b")) == [a or b for a, b in rows]
    assert values(df, bf.last_truthy(df, "a", "b")) == [a and b for a, b in rows]
    assert values(df, bf.all_truthy(df, "a", "b")) == [bool(a and b) for a, b in rows]
    assert values(df, bf.any_truthy(df, "a", "b")) == [bool(a or b) for a, b in rows]


@pytest.mark.parametrize("kind", ["int", "bigint", "double"])
def test_modulo_and_floor_division(spark, kind):
    number = float if kind == "double" else int
    rows = [(number(a), number(b)) for a in range(-9, 10) for b in (-4, -3, -1, 1, 3, 4)]
    if kind == "double":
        rows += [(1.0, 0.1), (-1.0, 0.1), (7.5, -2.5), (0.3, 0.1)]
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    assert list(map(repr, values(df, bf.modulo("a", "b")))) == [repr(a % b) for a, b in rows]
    assert values(df, bf.floor_div(df, "a", "b")) == [a // b for a, b in rows]


def test_division_by_zero_fails(spark):
    df = spark.createDataFrame([(1, 0)], "a int, b int")
    for column in (bf.modulo("a", "b"), bf.floor_div(df, "a", "b"), F.expr("a / b")):
        with pytest.raises(PySparkException):
            values(df, column)


def test_split_takes_the_separator_literally(spark):
    df = spark.createDataFrame([("a.b|c",), ("",)], "s string")
    assert values(df, bf.split_get("s", ".", 0)) == ["a", ""]
    assert values(df, bf.split_get("s", "|", 1)) == ["c", None]
    assert values(df, bf.split_get("s", ".", -1)) == ["b|c", ""]
    assert values(df, bf.split_get("s", ".", -3)) == [None, None]


def test_text_helpers(spark):
    texts = ["\t abcdef \n", "x", "", "  "]
    df = spark.createDataFrame([(text,) for text in texts], "s string")
    assert values(df, bf.strip("s")) == [text.strip() for text in texts]
    for start, stop in [(0, 3), (2, None), (-3, None), (1, -1), (None, -2), (5, 2), (-50, 50)]:
        assert values(df, bf.slice_text("s", start, stop)) == [text[start:stop] for text in texts]
    assert values(df, bf.contains("s", "'cd'")) == ["cd" in text for text in texts]
    assert values(df, bf.replace("s", "b", "$1")) == [text.replace("b", "$1") for text in texts]


def test_rounding_goes_to_even(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, -0.5, -1.5, 2.4)], "v double")
    assert values(df, bf.round_half_even("v")) == [0, 2, 2, 0, -2, 2]


def test_null_equality(spark):
    df = spark.createDataFrame([(None,), (1,)], "v int")
    assert values(df, bf.equals("v", "null")) == [True, False]


def test_text_of_values(spark):
    numbers = [0.0, -0.0, 1e20, 1e16, 1e15, 12345678.9, 1e7, 0.001, 0.0001, 0.00001, -2.5e-7, 1.3636470000000002e17,
               float("inf"), float("-inf"), float("nan"), 2e23, 0.1 + 0.2]
    df = spark.createDataFrame([(x,) for x in numbers], "v double")
    assert values(df, bf.as_text(df, "v")) == [str(x) for x in numbers]
    df = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert values(df, bf.as_text(df, "v")) == ["True", "False", "None"]


def test_casts_follow_python(spark):
    text = spark.createDataFrame([(x,) for x in (" 7 ", "-3", "1_000", "+5")], "v string")
    assert values(text, bf.cast_as(text, "v", "int")) == [7, -3, 1000, 5]
    text = spark.createDataFrame([(x,) for x in ("1.5", " 2 ", "1_0.5", "inf", "1e3")], "v string")
    assert values(text, bf.cast_as(text, "v", "double")) == [1.5, 2.0, 10.5, float("inf"), 1000.0]
    number = spark.createDataFrame([(x,) for x in (1.9, -1.9, 0.0)], "v double")
    assert values(number, bf.cast_as(number, "v", "int")) == [1, -1, 0]
    flag = spark.createDataFrame([(True,), (False,)], "v boolean")
    assert values(flag, bf.cast_as(flag, "v", "int")) == [1, 0]
    assert values(flag, bf.cast_as(flag, "v", "double")) == [1.0, 0.0]
    text = spark.createDataFrame([("False",), ("",)], "v string")
    assert values(text, bf.cast_as(text, "v", "bool")) == [True, False]


@pytest.mark.parametrize("bad,kind", [("1.5", "int"), ("", "int"), ("x", "double"), ("1.0d", "double"), ("2_", "int")])
def test_refused_casts_fail(spark, bad, kind):
    df = spark.createDataFrame([(bad,)], "v string")
    with pytest.raises(PySparkException):
        values(df, bf.cast_as(df, "v", kind))


def test_field_guards(events):
    with pytest.raises(ValueError, match="already"):
        create_field(events, "value", "1", "int")
    with pytest.raises(ValueError, match="not in the schema"):
        change_field(events, "other", "1")
    with pytest.raises(ValueError, match="not in the schema"):
        delete_field(events, "other")
    with pytest.raises(ValueError, match="unknown field type"):
        create_field(events, "other", "1", "long")
    with pytest.raises(PySparkException):
        filter_rows(events, "no_such_field > 1")


def test_change_keeps_or_replaces_the_type(events):
    assert change_field(events, "value", "value > 20").schema["value"].dataType == field_type("double")
    assert change_field(events, "value", "value > 20", "string").schema["value"].dataType == field_type("string")
    assert change_field(events, "value", "value + 1").columns == events.columns


def test_declared_schema():
    schema = record_schema({"b": "int", "a": "string"})
    assert schema.fieldNames() == ["a", "b"]
    assert [type_name(field.dataType) for field in schema] == ["string", "int"]


def test_python_function(events):
    added = create_field(events, "up", bf.from_python(lambda s: s.str.upper(), "string", "event_type"), "string")
    assert added.filter("up <> upper(event_type)").count() == 0


def test_sql_functions_mean_what_python_means(spark):
    from brooklet.functions.sql import register_functions

    register_functions(spark)
    cases = {
        "py_mod(-7, 3)": -7 % 3, "py_mod(7, -3)": 7 % -3, "py_floordiv(-7, 2)": -7 // 2, "py_floordiv(-2147483648, 3)": -2147483648 // 3,
        "py_fmod(-7.5D, 2D)": -7.5 % 2, "py_ffloordiv(1.0D, 0.1D)": 1.0 // 0.1, "py_round(2.5D)": round(2.5), "py_round(-3.5D)": round(-3.5),
        "py_int(' 1_000 ')": int(" 1_000 "), "py_float('1_0.5')": float("1_0.5"), "py_split('a.b.c', '.', -1)": "a.b.c".split(".")[-1],
        "py_split('a||b', '||', 1)": "a||b".split("||")[1], "py_slice('hello', 1, -1)": "hello"[1:-1], "py_slice('hello', null, 2)": "hello"[:2],
        "py_slice('hello', -3, null)": "hello"[-3:], "py_slice('hi', 5, 1)": "hi"[5:1], "py_strip('\t a ')": "\t a ".strip(),
        "py_in('el', 'hello')": "el" in "hello", "truthy(0)": bool(0), "truthy(0.5)": bool(0.5), "truthy_text('')": bool(""),
        "py_or('', 'x')": "" or "x", "py_and('a', 'x')": "a" and "x", "py_number_or(0, 3)": 0 or 3.0, "py_number_and(2, 3)": 2 and 3.0,
        "py_bool_str(true)": str(True),
    }
    found = spark.range(1).selectExpr(*[f"{text} as `c{place}`" for place, text in enumerate(cases)]).collect()[0]
    assert dict(zip(cases, found)) == cases


def test_floor_division_at_the_ends_of_the_type(spark):
    numbers = spark.createDataFrame([(-2147483648, 3), (2147483647, -2), (-2147483648, -3)], "a int, b int")
    assert [row["q"] for row in numbers.select(bf.floor_div(numbers, "a", "b").alias("q")).collect()] == [-2147483648 // 3, 2147483647 // -2, -2147483648 // -3]


def test_new_fields_differ_by_more_than_case(spark):
    from brooklet.operators import create_field

    df = spark.createDataFrame([(1,)], "value int")
    with pytest.raises(ValueError, match="already"):
        create_field(df, "Value", "1", "int")


def test_casts_need_the_strict_mode(spark):
    df = spark.createDataFrame([("x",)], "v string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            create_field(df, "n", "v", "int")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
