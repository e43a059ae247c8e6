"""Quality rules against plain counting."""

import math
import random
from collections import Counter, defaultdict

import pytest
from corpora import edge_rows, lower, table, words

from brooklet.llm.quality import CLASSES, Rules, judge_quality

BASE = Rules(min_reference_words=5)


def plain_class(c):
    if "a" <= c <= "z":
        return 0
    if "A" <= c <= "Z":
        return 1
    if "0" <= c <= "9":
        return 2
    if c in " \t\n\x0b\x0c\r":
        return 3
    if c in ".,;:!?'\"()-":
        return 4
    if " " < c < "\x7f":
        return 5
    if c <= "\x7f":
        return 6
    return 7 if "\xc0" <= c <= "ɏ" else 8


def plain_distance(p, q):
    total = 0
    for key in set(p) | set(q):
        a, b = p.get(key, 0), q.get(key, 0)
        total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(total, 0))


def plain_repeats(own):
    windows = [tuple(own[place : place + 5]) for place in range(len(own) - 4)]
    times = Counter(windows)
    return len({place + step for place, window in enumerate(windows) if times[window] > 1 for step in range(5)})


def plain_judge(rows, rules):
    counts, classes = defaultdict(Counter), defaultdict(Counter)
    for row in rows:
        text, lang = row[1] or "", row[2] if len(row) > 2 else None
        if lang is not None:
            counts[lang].update(words(lower(text)))
            classes[lang].update(map(plain_class, text))
    refs = {}
    for lang in sorted(counts):
        total = sum(counts[lang].values())
        if total >= rules.min_reference_words:
            top = sorted(counts[lang].items(), key=lambda item: (-item[1], item[0].encode()))[: rules.common_words]
            refs[lang] = {w: n / total for w, n in top}, {k: n / sum(classes[lang].values()) for k, n in classes[lang].items()}
    for row in rows:
        text = row[1] or ""
        own = words(text)
        lines = [line for line in text.split("\n") if words(line)]
        repeats = plain_repeats(own)
        failed = len(own) < 10 or 100 * repeats > 20 * len(own)
        mine, chars = Counter(words(lower(text))), Counter(map(plain_class, text))
        fits = []
        for lang, (common, shares) in refs.items():
            p = {w: mine[w] / max(len(own), 1) for w in common}
            p["\n rest"], q = 1 - sum(p.values()), common | {"\n rest": 1 - sum(common.values())}
            by_class = plain_distance({k: n / len(text) for k, n in chars.items()}, shares) if len(text) >= rules.min_chars else 0
            by_word = plain_distance(p, q) if len(own) >= rules.min_words else 0
            fits.append((max(by_class / rules.max_class_distance, by_word / rules.max_word_distance), lang))
        excess, nearest = min(fits, default=(None, None))
        symbols, dups = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
        yield row[0], len(own), sum(map(len, own)), symbols, dups, repeats, failed, nearest, excess, not failed and (excess is None or excess <= 1)


def check(spark, rows, rules=BASE):
    found = judge_quality(table(spark, rows), rules=rules).collect()
    key = lambda row: (str(row[0]), *row[1:7])
    wanted = sorted(plain_judge(rows, rules), key=key)
    assert len(found) == len(wanted)
    for ours, theirs in zip(sorted(map(tuple, found), key=key), wanted):
        assert ours[:7] == theirs[:7]
        assert ours[8] == pytest.approx(theirs[8], abs=1e-9)
        if theirs[8] is None or abs(theirs[8] - 1) > 1e-9:
            assert ours[9] == theirs[9]
    return {row["doc_id"]: row for row in found}


def corpus(n=60, seed=3):
    draw, rows = random.Random(seed), []
    vocabulary = {"en": "the of and a to in is it was for".split(), "de": "der die und das ist zu ein für nicht über".split()}
    for number in range(n):
        lang = "de" if number % 3 == 0 else "en"
        rare = ["".join(draw.choices("abcdefghinorst" + ("äöü" if lang == "de" else ""), k=draw.randint(3, 9))) for _ in range(200)]
        text = [draw.choice(vocabulary[lang]) if draw.random() < 0.45 else draw.choice(rare) for _ in range(draw.randint(5, 400))]
        rows.append((number, ". ".join(" ".join(text[k : k + 9]).capitalize() for k in range(0, len(text), 9)) + ".", lang if number % 7 else None))
    return rows


def junk():
    draw = random.Random(9)
    caps = " ".join("".join(draw.choices("QWXZ", k=4)) + "!!" for _ in range(200))
    marks = " ".join("".join(draw.choices("abcde", k=4)) + "###&&&" for _ in range(200))
    menu = " | ".join("".join(draw.choices("abcdefgh", k=7)) for _ in range(200))
    loop = "same five words again here " * 40
    return [(1000, caps, "en"), (1001, marks, "de"), (1002, menu, "en"), (1003, loop, "en"), (1004, caps, "no such"), (1005, "one\ntwo\none\n\n\none", "en")]


@pytest.mark.parametrize("languages_each", [2000, 1])
def test_against_plain_counts(spark, languages_each):
    found = check(spark, corpus() + junk(), Rules(min_reference_words=300, languages_each=languages_each))
    assert not any(found[number]["kept"] for number in (1000, 1001, 1002, 1003))
    long = [row for number, row in found.items() if number < 1000 and row["n_words"] >= 50]
    assert len(long) > 30 and all(row["kept"] for row in long)


def test_edges(spark):
    check(spark, edge_rows())
    check(spark, edge_rows() * 2, Rules(min_reference_words=5, min_chars=1, min_words=1, common_words=3))


def test_no_references(spark):
    """Without labelled words only the counts decide."""
    rows = [(1, "ten words are enough when they do not repeat themselves"), (2, "few words"), (3, None)]
    found = check(spark, rows)
    assert [found[number]["kept"] for number in (1, 2, 3)] == [True, False, False]
    assert judge_quality(table(spark, [])).collect() == []


def test_windows_do_not_cross_texts(spark):
    """Windows count within a text only, also where many texts are measured together."""
    rows = [(number, "alpha beta gamma delta epsilon " * (1 + number % 2), "en") for number in range(40)]
    found = check(spark, rows)
    assert {row["n_repeat_words"] for row in found.values()} == {0, 10}


def test_very_long_text(spark):
    draw = random.Random(1)
    text = " ".join(f"w{draw.randint(0, 40)}" for _ in range(300_000))
    check(spark, [(1, text, "en"), (2, text[:5000], "en")])
    assert CLASSES == 9
