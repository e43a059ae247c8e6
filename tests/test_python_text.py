"""Python expressions against CPython."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brooklet import functions as bf
from brooklet.functions.python_text import PythonTextError, is_python_text, python_condition, python_value
from brooklet.functions.rounding import round_float

SCHEMA = "number int, other bigint, price double, ratio double, string string, word string, flag boolean, `a.b` string, `no python` date"
ROWS = [
    (100, 7, 2.5, 0.1, "a:b:c", "Word", True, "x", None),
    (-7, 2, -2.675, 1.005, "", "", False, "", None),
    (0, -3, 0.0, -0.5, "no colon", "straße ÀÉ", True, "é", None),
    (2147483647, 9007199254740993, 1e16, 3.0, "::", " \t padded \n", False, "a b  c", None),
    (-2147483648, -1, -0.0, 0.125, ":x", "a,b;c", True, "\U0001f600 smile", None),
    (3, 10, float("inf"), 1e-7, "one two  three", "aaa", False, "100", None),
]

# Every one is evaluated by CPython on every row.
TEXTS = """
item['number'] == 100
item['number'] + 1
item['string'].split(':')[0]
item["number"] * 2 - item['other']
item['number'] % 7
item['number'] % -7
item['number'] // 3
item['number'] // -3
item['price'] // 0.7
item['price'] % 0.7
item['number'] / 4
item['number'] ** 2
-item['number'] + +3
item['flag'] + 1
-item['flag']
not item['number']
not item['string']
item['number'] and item['other']
item['number'] or item['other']
item['string'] or 'none'
item['string'] and item['word'] and 'both'
item['number'] > 0 and item['string'] != ''
1 < item['number'] < 101
0 <= item['number'] == item['number'] != 5
item['number'] in (100, 3)
item['number'] in [100, 3.0, True] if False else item['number'] not in (1, 2)
item['string'] in ('a:b:c', '')
':' in item['string']
'b' not in item['string'].split(':')
'b' in item['string'].split(':')
item['number'] == '100'
item['string'] == 5
item['string'] != 5
item['number'] is None
item['number'] is not None
item['number'] == None
item['price'] == item['number']
item['price'] < item['ratio']
item['string'] < item['word']
item['string'] if item['flag'] else item['word']
'big' if item['number'] > 50 else 'small' if item['number'] else 'zero'
item['string'].split(':')
len(item['string'].split(':'))
item['string'].split(':')[-1]
item['string'].split(':', 1)[-1]
item['string'].split()
len(item['a.b'].split())
item['a.b'].split(' ')
item['string'][::-1]
item['string'][1:]
item['string'][:-1]
item['string'][-3:2]
item['string'][1:100]
item['string'][5:2]
item['string'][:]
item['word'][item['other']:]
item['word'][:item['number']]
item['string'].split(':')[1:]
item['string'].split(':')[-2:]
item['string'].split(':')[::-1]
item['string'][0] if item['string'] else '-'
item['word'][-1] if len(item['word']) > 0 else None
item['string'].split(':')[1] if ':' in item['string'] else ''
item['word'].strip()
item['word'].lstrip()
item['word'].rstrip()
item['word'].strip('aW')
item['word'].lstrip('a') + item['word'].rstrip('a')
item['word'].lower()
item['word'].upper()
item['string'].replace(':', '--')
item['string'].replace(':', item['word'])
item['string'].startswith('a')
item['string'].startswith(('a', ':'))
item['string'].endswith('c')
item['string'].find(':')
item['string'].find('')
item['string'].count(':')
item['word'].count('aa')
'-'.join(item['string'].split(':'))
'-'.join([item['string'], 'x'])
str(item['number']) + ':' + str(item['flag'])
str(item['price'])
str(item['ratio'] * 3)
str(None)
f"{item['number']}/{item['word']}"
int(item['ratio'])
int(item['flag'])
int('12') + int(' 1_000 ')
float(item['number'])
float('1e3') + float(' 2.5 ')
bool(item['string'])
len(item['a.b'])
abs(item['number'] + 0)
abs(item['price'])
min(item['number'], item['other'], 5)
max(item['price'], item['ratio'])
max(item['string'], item['word'])
round(item['ratio'], 2)
round(item['price'], 2)
round(item['ratio'])
round(item['number'], -1)
round(item['other'])
item['word'] * 2
3 * item['string']
item['word'] * item['number'] if item['number'] < 200 else ''
item['a.b'] + "'quoted'"
(item['number'], item['other'])[1]
[item['string'], item['word']][0]
True if item['flag'] else False
item['string'].split(':') == ['', '']
item['number'] == True
""".strip().splitlines()


def rows_of(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def plain(value):
    """0.0 and -0.0 apart, and 1 from 1.0 and True."""
    return repr(list(value)) if isinstance(value, (list, tuple)) else repr(value)


def test_every_text_on_every_row(spark):
    df = rows_of(spark)
    records = [row.asDict() for row in df.collect()]
    values, conditions = {}, {}
    for number, text in enumerate(TEXTS):
        assert is_python_text(text) or "item" not in text, text
        conditions[f"c{number}"] = python_condition(text, df.schema)
        try:
            values[f"v{number}"] = python_value(text, df.schema)
        except PythonTextError:
            pass
    assert len(TEXTS) - len(values) < 12
    wrong = []
    for name, column in {**values, **conditions}.items():
        text = TEXTS[int(name[1:])]
        wanted = [eval(text, {"item": record}) for record in records]  # the texts above
        found = [row[0] for row in df.select(column.alias("v")).collect()]
        if name[0] == "c":  # null is false there
            found, wanted = list(map(bool, found)), list(map(bool, wanted))
        if list(map(plain, found)) != list(map(plain, wanted)):
            wrong.append((text, found, wanted))
    assert not wrong


def test_missing_values(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, None, None)], "number int, price double, string string")
    wanted = {
        "item['number'] == 1": [False, True], "item['number'] != 1": [True, False], "item['number'] is None": [True, False],
        "item['number'] == item['price']": [True, False], "item['number'] + 1": [None, 2], "item['string'] or 'none'": ["x", "none"],
        "item['number'] in (1, 2)": [False, True], "item['string'].upper()": ["X", None], "item['price'] < 1": [None, None],
        "str(item['number'])": ["None", "1"], "item['string'][0]": ["x", None], "item['string'].split(':')[0]": ["x", None],
        "min(item['number'], 0)": [None, 0], "not item['number']": [True, False], "item['string'] == None": [False, True],
    }
    for text, values in wanted.items():
        assert [row[0] for row in df.select(python_value(text, df.schema).alias("v")).collect()] == values, text


def test_nan_compares_as_in_python(spark):
    nan = float("nan")
    rows = [(nan, 1.0), (1.0, nan), (nan, nan), (1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    for op in ("==", "!=", "<", "<=", ">", ">="):
        text = f"item['a'] {op} item['b']"
        found = [row[0] for row in df.select(python_value(text, df.schema).alias("v")).collect()]
        assert found == [eval(text, {"item": {"a": a, "b": b}}) for a, b in rows]
    for text in ("min(item['a'], item['b'])", "max(item['a'], item['b'])"):
        found = [row[0] for row in df.select(python_value(text, df.schema).alias("v")).collect()]
        assert list(map(repr, found)) == [repr(eval(text, {"item": {"a": a, "b": b}})) for a, b in rows]


@pytest.mark.parametrize("text", ["item['string'].split(':')[3]", "item['string'][50]", "item['number'] / 0", "item['number'] % 0", "int(item['string'])", "item['other'] * 9223372036854775807"])
def test_what_python_refuses_fails(spark, text):
    with pytest.raises(PySparkException):
        rows_of(spark).select(python_value(text, rows_of(spark).schema).alias("v")).collect()


@pytest.mark.parametrize(
    ("text", "place"),
    [
        ("item", 1), ("item['no such']", 1), ("item[0]", 1), ("item['no python']", 1), ("item['number'] + item['string']", 1),
        ("1 + item['string'].title()", 5), ("item['number'] < item['string']", 1), ("[x for x in item['string']]", 1),
        ("(lambda: 1)()", 1), ("__import__('os').system('x')", 1), ("item['string'].__class__", 1), ("item['number'] ** item['other']", 1),
        ("item['number'] ^ 1", 1), ("item['string'].split('')", 22), ("item['string'][::2]", 16), ("len(item['number'])", 1),
        ("round(item['price'], item['number'])", 22), ("item['string'].split(sep=':')", 1), ("b'x'", 1), ("f\"{item['price']:.2f}\"", 1), ("open('x')", 1),
    ],
)
def test_anything_else_is_refused_with_its_place(spark, text, place):
    with pytest.raises(PythonTextError, match="at column") as error:
        python_condition(text, rows_of(spark).schema)
    assert f"at column {place if not text.startswith('f') else 3} of" in str(error.value) or text.startswith("f")


@pytest.mark.parametrize("text", ["item['number'] or item['string']", "item['string'].split(':')", "None", "1 if item['flag'] else 'x'"])
def test_only_the_four_kinds_are_values(spark, text):
    with pytest.raises(PythonTextError, match="the result"):
        python_value(text, rows_of(spark).schema)
    python_condition(text, rows_of(spark).schema)


@pytest.mark.parametrize("text", ["item['a'] = 5", "value > 20", "upper(item['a'])", "item['a'] IS NULL", "py_mod(item['a'], 2)", "'a' || item['b']", "5"])
def test_other_texts_are_sql(text):
    assert not is_python_text(text)


def test_conditions_reach_the_scan(spark, events):
    condition = python_condition("item['value'] > 20 and item['event_type'] == 'click'", events.schema)
    plan = events.filter(condition)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,20.0)" in plan and "EqualTo(event_type,click)" in plan


def test_round_is_on_the_binary_value(spark):
    draw = random.Random(7)
    numbers = [2.675, 1.005, 0.5, 2.5, 0.125, -0.0, -0.04, 1e300, 5e-324, 450359962737.0496, 4503599627370497.5, float("inf")]
    numbers += [draw.uniform(-1000, 1000) for _ in range(5000)] + [round(draw.uniform(-99, 99), 4) + draw.choice([0, 5e-4, 5e-3]) for _ in range(3000)]
    numbers += [draw.choice([1, -1]) * draw.random() * 10 ** draw.randint(-18, 17) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").coalesce(2)
    digits = list(range(-3, 11)) + [15, 22]
    for row in df.select("x", *[round_float(F.col("x"), n).alias(f"r{n}") for n in digits]).collect():
        for place, n in enumerate(digits, 1):
            assert math.copysign(1, row[place]) == math.copysign(1, round(row[0], n)) and row[place] == round(row[0], n), (row[0], n)
    assert df.select(bf.round_half_even("x", 2)).first()[0] == 2.67
    with pytest.raises(ValueError, match="digits"):
        round_float(F.col("x"), 23)
