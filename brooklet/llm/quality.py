"""Quality rules: a document's histograms of character classes and common words against those of languages.

All documents with a language label make the references: per language the
shares of the character classes, and of its commonest words.  A document is
compared with every language by the Jensen-Shannon distance (base 2, 0 to 1)
and judged by the language that suits it best, so a wrong label does no harm.
Short texts are too coarse a sample: below a minimum length a histogram is not
judged.  Plain counts (repeated lines, repeated word windows, symbols) go first.

Texts are read twice, once for the references and once for the verdicts, and
never moved; what is shuffled are counts per language, class and word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brooklet.llm.common import BLANKS, WORD, land, pick

# Character classes; code points of 0x80 and more: Latin letters and the rest.
LOWER, UPPER, DIGIT, BLANK, MARK, SIGN, CONTROL, LATIN, REST = range(9)
CLASSES = 9
MARKS = ".,;:!?'\"()-"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Code points and documents that are measured at once.
PIECE, PIECE_ROWS = 1 << 19, 256
# The commonest words of a language are found in this many parts, then among the parts' winners.
PARTS = 256


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; distances are Jensen-Shannon distances."""

    common_words: int = 64
    min_chars: int = 200  # code points, for the class histogram
    min_words: int = 50  # words, for the word histogram
    max_class_distance: float = 0.3
    max_word_distance: float = 0.5
    min_reference_words: int = 1000  # a language with fewer words in all its documents is no reference
    languages_each: int = 2000  # references that are sent to the tasks at once


@dataclass(frozen=True)
class References:
    """A block of languages: shares of classes (rows: languages) and of common words (rows: languages, columns: their union)."""

    langs: list[str]
    classes: np.ndarray
    words: np.ndarray
    own: np.ndarray  # which words are common in which language
    index: dict[str, int] = field(repr=False)


def _class_table() -> np.ndarray:
    table = np.full(0x251, REST, dtype=np.int64)
    table[:0x80] = SIGN
    table[:0x20], table[0x7F] = CONTROL, CONTROL
    table[0xC0:0x250] = LATIN
    for kind, first, last in ((LOWER, "a", "z"), (UPPER, "A", "Z"), (DIGIT, "0", "9")):
        table[ord(first) : ord(last) + 1] = kind
    table[[ord(c) for c in BLANKS]] = BLANK
    table[[ord(c) for c in MARKS]] = MARK
    return table


CLASS = _class_table()
SYMBOL = np.isin(np.arange(0x251), [ord(c) for c in SYMBOLS])
_WORDS = re.compile(WORD)


@dataclass(frozen=True)
class Measures:
    """Counts of a piece's documents."""

    classes: np.ndarray  # (documents, classes)
    symbols: np.ndarray
    words: np.ndarray  # number of words
    owner: np.ndarray  # of each word: its document
    code: np.ndarray  # of each word: its place in ``distinct``
    distinct: np.ndarray


def measure(texts: list[str]) -> Measures:
    lengths = np.array([len(text) for text in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.minimum(points, 0x250)
    of = np.repeat(np.arange(len(texts)), lengths)
    classes = np.bincount(of * CLASSES + CLASS[points], minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES)
    symbols = np.bincount(of, weights=SYMBOL[points], minlength=len(texts)).astype(np.int64)
    found = [_WORDS.findall(text) for text in texts]
    counts = np.array([len(words) for words in found], dtype=np.int64)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [word for words in found for word in words]
    code, distinct = pd.factorize(flat)
    return Measures(classes, symbols, counts, np.repeat(np.arange(len(texts)), counts), code.astype(np.int64), distinct)


def repeated_words(owner: np.ndarray, code: np.ndarray, documents: int) -> np.ndarray:
    """Per document the words inside a window of WINDOW words that its text holds twice or more.

    Windows are told apart exactly: by their number among the distinct pairs of
    shorter windows, two words, four, then five.
    """
    n = len(code)
    if n < WINDOW:
        return np.zeros(documents, dtype=np.int64)
    pair, pairs = pd.factorize(code[:-1] * (code.max() + 1) + code[1:])
    four, fours = pd.factorize(pair[:-2].astype(np.int64) * len(pairs) + pair[2:])
    five, fives = pd.factorize(four[:-1].astype(np.int64) * (code.max() + 1) + code[WINDOW - 1 :])
    inside = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    own, owns = pd.factorize(owner[: n - WINDOW + 1] * len(fives) + five)
    begins = np.flatnonzero(inside & (np.bincount(own[inside], minlength=len(owns))[own] > 1))
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + WINDOW, -1)
    return np.bincount(owner, weights=np.cumsum(edges[:-1]) > 0, minlength=documents).astype(np.int64)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def lower(word: str) -> str:
    return word.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: A-Z only


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut by documents, so that what is measured at once is bounded by a piece and one document."""
    for batch in batches:
        column, begin, texts, size = batch.column("text"), 0, [], 0
        for row in range(len(batch)):
            texts.append(column[row].as_py() or "")
            size += len(texts[-1])
            if size >= PIECE or len(texts) >= PIECE_ROWS or row + 1 == len(batch):
                yield batch.slice(begin, len(texts)), texts
                begin, texts, size = row + 1, [], 0


def _histograms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, class, n): counts of classes (no word) and of lower-cased words (no class)."""
    for batch, texts in _pieces(batches):
        found = measure(texts)
        lang, langs = pd.factorize(np.array(batch.column("lang").to_pylist(), dtype=object))
        classes = np.zeros((len(langs), CLASSES), dtype=np.int64)
        np.add.at(classes, lang, found.classes)
        low, lows = pd.factorize(np.array([lower(word) for word in found.distinct], dtype=object))
        key, n = np.unique(lang[found.owner] * max(len(lows), 1) + low[found.code] if len(found.code) else found.code, return_counts=True)
        names, words = pa.array(langs, pa.string()), pa.array(lows, pa.string())
        yield pa.record_batch(
            [
                names.take(pa.array(np.repeat(np.arange(len(langs)), CLASSES))), pa.nulls(classes.size, pa.string()),
                pa.array(np.tile(np.arange(CLASSES, dtype=np.int32), len(langs))), pa.array(classes.ravel()),
            ],
            ["lang", "word", "class", "n"],
        )
        if len(key):
            yield pa.record_batch(
                [names.take(pa.array(key // len(lows))), words.take(pa.array(key % len(lows))), pa.nulls(len(key), pa.int32()), pa.array(n)],
                ["lang", "word", "class", "n"],
            )


def histograms(rows: DataFrame, rules: Rules) -> DataFrame:
    """(lang, word, class, n, total): classes and common words of the languages that have enough words; total: all words of the language."""
    texts = rows.filter("lang is not null and text is not null").select("lang", "text")
    counts = land(texts.mapInArrow(_histograms, "lang string, word string, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n")))
    words, classes = counts.filter("word is not null"), counts.filter("class is not null")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= rules.min_reference_words)
    first = [F.col("n").desc(), F.col("word")]
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS))
    best = words.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*first)))
    best = best.filter(F.col("rank") <= rules.common_words).drop("part")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*first))).filter(F.col("rank") <= rules.common_words)
    return land(best.drop("rank").unionByName(classes).join(totals, "lang"))


def _references(taken: list) -> References:
    langs = sorted({row["lang"] for row in taken})
    place = {lang: number for number, lang in enumerate(langs)}
    index = {word: number for number, word in enumerate(sorted({row["word"] for row in taken if row["word"] is not None}))}
    classes, words = np.zeros((len(langs), CLASSES)), np.zeros((len(langs), len(index)))
    for row in taken:
        if row["word"] is None:
            classes[place[row["lang"]], row["class"]] = row["n"]
        else:
            words[place[row["lang"]], index[row["word"]]] = row["n"] / row["total"]
    return References(langs, classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), words, words > 0, index)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over the last axis of the two shares' parts of the Jensen-Shannon divergence, in bits."""
    both = p + q
    safe = np.where(both > 0, both, 1)
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, 2 * x, 1) / safe), 0)
    return 0.5 * (part(p) + part(q)).sum(axis=-1)


def distances(found: Measures, references: References) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each document to each language: of classes, of common words (the others count as one)."""
    documents, langs = len(found.words), len(references.langs)
    shares = found.classes / np.maximum(found.classes.sum(axis=1, keepdims=True), 1)
    place = np.array([references.index.get(lower(word), -1) for word in found.distinct], dtype=np.int64)
    known = place[found.code] if len(found.code) else found.code
    size = max(len(references.index), 1)
    common = np.bincount(found.owner[known >= 0] * size + known[known >= 0], minlength=documents * size).reshape(documents, size)
    common = common / np.maximum(found.words, 1)[:, None]
    by_class, by_word = np.empty((documents, langs)), np.empty((documents, langs))
    for number in range(langs):
        by_class[:, number] = divergence(shares, references.classes[number])
        own = references.own[number]
        p, q = common[:, own] if len(references.index) else common[:, :0], references.words[number][own]
        rest = divergence(np.maximum(1 - p.sum(axis=1), 0)[:, None], np.maximum(1 - q.sum(), 0)[None])
        by_word[:, number] = divergence(p, q) + rest
    return np.sqrt(np.maximum(by_class, 0)), np.sqrt(np.maximum(by_word, 0))


def _judge(rules: Rules, shared, first: bool):
    """Counts (the first time) and the least ``excess`` over the languages seen so far: the larger distance in parts of the allowed one."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pieces(batches):
            found = measure(texts)
            names = batch.schema.names
            columns = {name: batch.column(name) for name in names}
            if shared is not None:
                columns |= _compared(found, shared.value, rules, columns["nearest"], columns["excess"])
            if first:
                columns |= _counted(found, texts)
            yield pa.record_batch(list(columns.values()), list(columns))

    return emit


def _compared(found: Measures, references: References, rules: Rules, nearest: pa.Array, excess: pa.Array) -> dict[str, pa.Array]:
    by_class, by_word = distances(found, references)
    by_class[found.classes.sum(axis=1) < rules.min_chars] = 0
    by_word[found.words < rules.min_words] = 0
    now = np.maximum(by_class / rules.max_class_distance, by_word / rules.max_word_distance)
    best = now.argmin(axis=1)
    least, before = now[np.arange(len(best)), best], excess.to_numpy(zero_copy_only=False)
    names = [references.langs[place] for place in best]
    olds = nearest.to_pylist()
    # Of equals the first by code point, in whatever order the blocks come.
    better = [old is None or new < was or (new == was and name < old) for name, old, new, was in zip(names, olds, least, before)]
    langs = [name if use else old for name, old, use in zip(names, olds, better)]
    return {"nearest": pa.array(langs, pa.string()), "excess": pa.array(np.where(better, least, before))}


def _counted(found: Measures, texts: list[str]) -> dict[str, pa.Array]:
    numbers = {
        "n_words": found.words, "word_chars": found.classes.sum(axis=1) - found.classes[:, BLANK], "n_symbols": found.symbols,
        "n_dup_lines": np.array([repeated_lines(text) for text in texts], dtype=np.int64),
        "n_repeat_words": repeated_words(found.owner, found.code, len(texts)),
    }
    return {name: pa.array(values) for name, values in numbers.items()}


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, nearest, excess, kept.

    ``base_failed``: fewer than 10 words, or over a fifth of the words inside
    five-word windows that the text repeats.  ``nearest`` is the language whose
    histograms suit best (the first by code point of equals), ``excess`` the
    larger of its two distances in parts of the allowed one (0 where the text
    is too short for both); a document is kept if it did not fail and
    ``excess`` is at most 1.  Where no language has enough labelled words,
    ``nearest`` and ``excess`` are null and only the counts decide.  A null
    text has no words; a null ``lang`` makes no reference but is judged like
    any other.  Repeated rows count and are judged one by one.  Other columns
    are not looked at.  An empty table gives an empty result.
    """
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang)
    shares = histograms(rows, rules)
    languages = shares.select("lang").distinct().count()
    blocks = -(-languages // rules.languages_each)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, nearest string, excess double"
    counts = ", ".join(f"{name} long" for name in COUNTS)
    judged, first = rows.select("doc_id", "text", F.lit(None).cast("string").alias("nearest"), F.lit(None).cast("double").alias("excess")), True
    for block in range(max(blocks, 1)):
        # About languages_each times (common_words + CLASSES) rows at once.
        taken = shares.filter(F.pmod(F.xxhash64("lang"), F.lit(max(blocks, 1))) == block).collect()
        if taken or first:
            shared = docs.sparkSession.sparkContext.broadcast(_references(taken)) if taken else None
            schema = f"{schema}, {counts}" if first else schema
            judged, first = judged.mapInArrow(_judge(rules, shared, first), schema), False
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    kept = ~F.col("base_failed") & F.coalesce(F.col("excess") <= 1, F.lit(True))
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), "nearest", "excess").withColumn("kept", kept)
