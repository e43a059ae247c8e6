"""Decontamination against looking for every window at every place."""

import random
import re

import pytest
from corpora import PASSAGE, edge_rows, lower, table

from brooklet.llm.decontamination import benchmark_windows, decontaminate

ITEMS = [(1, PASSAGE), (2, "tiny item"), (3, None), (4, ""), (5, "Fox"), (None, "lazy dog while nobody"), (10, PASSAGE), (1, "word5 x5 word6 x6")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain(rows, items, width=13, share=20):
    found = []
    windows = set()
    for item, text in items:
        own = words(text)
        size = min(width, len(own))
        windows |= {(item, tuple(own[at : at + size])) for at in range(len(own) - size + 1) if own}
    for doc_id, text, *_ in rows:
        own, hit, names = words(text), set(), set()
        for item, window in windows:
            for at in range(len(own) - len(window) + 1):
                if own[at] == window[0] and tuple(own[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    names |= {str(item)} if item is not None else set()
        found.append((doc_id, len(own), len(hit), sorted(names), 0 < len(hit) and share * len(hit) >= len(own)))
    return sorted(found, key=str)


def random_case(seed):
    draw = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "été", "x1"]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))
    return [(n, text(draw.randint(0, 60))) for n in range(40)], [(n, text(draw.randint(0, 9))) for n in range(25)]


CASES = [(edge_rows(), ITEMS), (edge_rows(), []), ([], ITEMS), random_case(1), random_case(2)]


@pytest.mark.parametrize("block", [200_000, 7])
@pytest.mark.parametrize("rows, items", CASES)
def test_decontaminate(spark, rows, items, block):
    benchmark = spark.createDataFrame([(*item, "text", 3) for item in items], "item_id bigint, text string, window string, n int")
    width = 13 if rows == edge_rows() else 6
    found = decontaminate(table(spark, rows), benchmark, width=width, block=block).collect()
    mine = [(row["doc_id"], row["n_words"], row["n_hit"], row["items"], row["contaminated"]) for row in found]
    assert sorted(mine, key=str) == plain(rows, items, width)
    for row in found:
        assert sum(row["spans"][1::2]) - sum(row["spans"][::2]) == row["n_hit"]


def test_windows(spark):
    benchmark = spark.createDataFrame([(1, "A b-c D e"), (2, "!!"), (1, "b c")], "item_id int, text string")
    found = {(row["item"], row["window"]) for row in benchmark_windows(benchmark, width=3).collect()}
    assert found == {("1", "a b c"), ("1", "b c d"), ("1", "c d e"), ("1", "b c")}


def test_windows_do_not_cross_texts(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id int, text string")
    found = decontaminate(table(spark, [(1, "one two three"), (2, "four five six"), (3, "zero one two three four five six")]), benchmark)
    assert sorted((row["doc_id"], row["n_hit"]) for row in found.collect()) == [(1, 0), (2, 0), (3, 6)]


def test_chunks(spark, monkeypatch):
    monkeypatch.setattr("brooklet.llm.decontamination.CHUNK", 50)
    from brooklet.llm.decontamination import _chunks

    texts = [b"a" * 40, b"b" * 40, None, b"c" * 500, b""]
    covered = [place for begin, end in _chunks(texts) for place in range(begin, end)]
    assert covered == list(range(len(texts)))
