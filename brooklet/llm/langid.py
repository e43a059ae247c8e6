"""Language identification by prediction by partial matching (PPM).

For each language a variable-order context tree over bytes holds how often a
byte followed the ``ORDER`` bytes before it, and every shorter context.  A byte
seen in the longest known context has count / (total + distinct); otherwise the
escape, distinct / (total + distinct), leads to the next shorter context, where
the bytes already excluded no longer count.  Below the empty context all symbols
are equally likely.  The statistics are frozen after training, so the cost in
bits of a byte after its context is a fixed number.  A text's code length is
the sum over all its bytes; the language with the shortest code wins.

Languages are scored in blocks whose trees have a bounded size, one pass over
the texts for each; the best answer of all blocks counts, so the blocks change
no result.

Bytes are folded first: A-Z to a-z, all other ASCII to one separator; bytes that
no training text has are one symbol.  Contexts do not reach across a text's
beginning, where a separator is taken to come before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brooklet.llm.common import crc_part, land, pick, text_tag

ORDER = 3
OTHER = 0x20
FOLD = np.array([b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else OTHER for b in range(256)], dtype=np.uint8)
SLAB = 1 << 20  # bytes times languages scored at once
UNKNOWN = "und"
KEPT = ["doc_id", "tag", "held_out", "letter"]
FAINT = -1000  # binary exponent below which likelihoods are not told apart
SENT_LANGS = 10_000  # up to so many, a row per language is sent to all tasks; beyond, joined
BLOCK_BYTES = 128 << 20  # bound of what is sent to the tasks for a block of languages; every block is a pass over the texts

# Bounds of the training sample: documents of a language, and their bytes on average.
SAMPLE_DOCS = 400
SAMPLE_BYTES = 20_000


def _before(data: np.ndarray, begins: np.ndarray, distance: int, fill: int) -> np.ndarray:
    """The byte ``distance`` places ahead of each byte; ``fill`` where that is before the byte's text."""
    moved = np.empty_like(data)
    moved[:distance] = fill
    moved[distance:] = data[: max(0, len(data) - distance)]
    for step in range(distance):
        places = begins + step
        moved[places[places < len(data)]] = fill
    return moved


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, ORDER bytes and the one after), combined per task."""
    found: dict[str, list] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                data = FOLD[np.frombuffer(text, dtype=np.uint8)]
                for at in range(0, len(data), SLAB):
                    far = max(0, at - ORDER)
                    part = data[far : at + SLAB]
                    code = part.astype(np.int64)
                    for distance in range(1, ORDER + 1):
                        code |= _before(part, np.zeros(1, dtype=np.int64), distance, OTHER).astype(np.int64) << (8 * distance)
                    found.setdefault(lang, []).append(np.unique(code[at - far :], return_counts=True))
    for lang, parts in found.items():
        codes, place = np.unique(np.concatenate([codes for codes, _ in parts]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])


@dataclass(frozen=True)
class Level:
    """What a block of languages knows of the contexts of one length; numbers are in the order of the sorted codes."""

    pairs: np.ndarray  # contexts with a symbol that some language has seen after them
    bits: np.ndarray  # (pair, language): cost of the symbol
    contexts: np.ndarray
    escapes: np.ndarray  # (context, language): cost of any other symbol beyond its cost after the next shorter context


def _find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``codes``, and which are there."""
    place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return place, codes[place] == wanted


@dataclass(frozen=True)
class ContextTrees:
    """Costs in bits after every context, one column per language; only what was seen in training is stored.

    A symbol that no language of the block has seen after a context costs the escape and what it costs after the next
    shorter one.  The empty context knows all symbols.
    """

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    levels: list[Level]  # by length of context

    def lengths(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Code length of each text in each language; text i is ``data[begins[i]:begins[i + 1]]``, none is empty."""
        total = np.zeros((len(begins) - 1, len(self.langs)))
        slab = max(1, SLAB // len(self.langs))
        for at in range(0, len(data), slab):
            far = max(0, at - ORDER)
            symbols = self.symbol[data[far : at + slab]]
            own = begins[:-1] - far
            own = own[(own >= 0) & (own < len(symbols))]
            before = [_before(symbols, own, distance, self.symbol[OTHER])[at - far :] for distance in range(1, ORDER + 1)]
            first = int(np.searchsorted(begins, at, side="right")) - 1
            last = int(np.searchsorted(begins, min(at + slab, len(data)), side="left"))
            cuts = np.maximum(begins[first:last], at) - at
            total[first:last] += np.add.reduceat(self.costs(symbols[at - far :], before), cuts, axis=0, dtype=np.float64)
        return total

    def costs(self, symbols: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Cost of each symbol in each language; ``before``: the symbols 1, 2, ... places ahead of it."""
        size = int(self.symbol.max()) + 1
        longest = _contexts(before, size)[ORDER]
        distinct, place_of = np.unique(longest * size + symbols, return_inverse=True)  # looked up once each
        symbols, longest = distinct % size, distinct // size
        costs = np.zeros((len(distinct), len(self.langs)), dtype=np.float32)
        left = np.arange(len(distinct))
        for order in range(ORDER, -1, -1):
            level, context = self.levels[order], longest[left] % size**order
            place, known = _find(level.pairs, context * size + symbols[left])
            costs[left[known]] += level.bits[place[known]]
            left, context = left[~known], context[~known]
            place, known = _find(level.contexts, context)
            costs[left[known]] += level.escapes[place[known]]
        return costs[place_of]


def _contexts(before: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Codes of the last 0, 1, ... symbols; the remainder by a power of ``size`` is the code of a shorter context."""
    codes = [np.zeros(len(before[0]), dtype=np.int64)]
    for distance, symbols in enumerate(before):
        codes.append(codes[-1] + symbols * size**distance)
    return codes


def _trees(grams: list, known: Iterable[int] = ()) -> ContextTrees:
    """Trees of the languages in ``grams``; ``known``: bytes that have a symbol besides those of the grams."""
    langs = sorted({row["lang"] for row in grams})
    number = {lang: place for place, lang in enumerate(langs)}
    gram = np.array([row["code"] for row in grams], dtype=np.int64)
    which = np.array([number[row["lang"]] for row in grams])
    n = np.array([row["n"] for row in grams], dtype=np.float64)
    known = sorted({OTHER, *FOLD[:0x80].tolist(), *np.unique(gram & 255).tolist(), *known})
    symbol = np.full(256, len(known), dtype=np.int64)
    symbol[known] = np.arange(len(known))
    symbol = symbol[FOLD]
    size = len(known) + 1
    parts = [symbol[(gram >> (8 * distance)) & 255] for distance in range(ORDER + 1)]
    levels: list[Level] = []
    chance = other = np.full((1, len(langs)), 1 / size)  # of the pairs, and of a symbol no text has, after each context
    for order, code in enumerate(_contexts(parts[1:], size)):
        seen = code * size + parts[0]
        pairs = np.unique(seen) if order else np.arange(size)
        contexts, first, context = np.unique(pairs // size, return_index=True, return_inverse=True)
        counts = np.bincount(np.searchsorted(pairs, seen) * len(langs) + which, weights=n, minlength=len(pairs) * len(langs))
        counts = counts.reshape(len(pairs), len(langs))
        total, distinct = np.add.reduceat(counts, first), np.add.reduceat((counts > 0).astype(np.float64), first)
        shorter = size ** max(order - 1, 0)
        if order:
            above = levels[-1]
            chance = chance[np.searchsorted(above.pairs, pairs // size % shorter * size + pairs % size)]
            other = other[np.searchsorted(above.contexts, contexts % shorter)]
        else:
            chance = np.repeat(chance, size, axis=0)
        # What the shorter context leaves to symbols not seen here; never less than for the one no text has.
        rest = np.maximum(1 - np.add.reduceat(np.where(counts > 0, chance, 0), first), other)
        scale = np.maximum(total + distinct, 1)
        escape = np.where(total > 0, distinct / scale / rest, 1)
        chance = np.where(counts > 0, counts / scale[context], escape[context] * chance)
        other = escape * other
        levels.append(Level(pairs, -np.log2(chance).astype(np.float32), contexts, -np.log2(escape).astype(np.float32)))
    return ContextTrees(langs, symbol, levels)


def training_sample(rows: DataFrame, docs_each: int, bytes_each: int) -> DataFrame:
    """At most about ``docs_each`` rows (lang, text) of each language, chosen by a hash of the document, whole texts.

    Texts of any length are taken, in the order of the hash, until a language has ``docs_each * bytes_each`` bytes;
    the first one always counts, and rows equal in id and text count once.
    """
    fit = rows.filter("lang is not null and text is not null").filter(F.octet_length("text") > 0)
    draw = F.pmod(F.xxhash64("doc_id", "tag", F.lit("sample")), F.lit(1 << 40))
    fit = fit.withColumn("draw", draw)
    chance = F.col("draw") / float(1 << 40)
    counts = land(fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first")))
    langs = counts.count()
    if not langs:
        return fit.select("lang", "text")
    sent = F.broadcast if langs <= SENT_LANGS else lambda df: df  # a row per language
    near = fit.join(sent(counts), "lang").filter((chance < docs_each / F.col("n")) | (F.col("draw") == F.col("first")))
    near = land(near.select("lang", "draw", "text").dropDuplicates(["lang", "draw"]))  # about docs_each documents a language
    order = Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = near.select("lang", "draw", F.octet_length("text").cast("long").alias("size"), F.min("draw").over(order).alias("first"))
    taken = sizes.withColumn("upto", F.sum("size").over(order)).filter((F.col("upto") <= docs_each * bytes_each) | (F.col("draw") == F.col("first")))
    last = taken.groupBy("lang").agg(F.max("draw").alias("last"))
    return near.join(sent(last), "lang").filter("draw <= last").select("lang", "text")


def train(rows: DataFrame, docs_each: int = SAMPLE_DOCS, bytes_each: int = SAMPLE_BYTES) -> Iterator[ContextTrees]:
    """Context trees of the languages in ``rows`` (doc_id, tag, lang, text), in blocks of up to ``BLOCK_BYTES``, one language at least.

    A language's counts are at most its bytes in the sample, far fewer in fact; those of one block are on the driver at a time.
    """
    sample = training_sample(rows, docs_each, bytes_each).withColumn("text", F.col("text").cast("binary"))
    grams = sample.mapInArrow(_grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    grams = land(grams)
    sizes = grams.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), F.collect_set(F.col("code").bitwiseAND(F.lit(255))).alias("known")).collect()
    known = {byte for row in sizes for byte in row["known"]}
    blocks: list[list[str]] = []
    room = 0
    for row in sorted(sizes, key=lambda row: row["lang"]):
        taken = room + row["grams"]
        # Pairs and contexts of all lengths, each with its code and a number per language.
        if not blocks or taken * 2 * ORDER * (8 + 4 * (len(blocks[-1]) + 1)) > BLOCK_BYTES:
            blocks.append([])
            taken = row["grams"]
        blocks[-1].append(row["lang"])
        room = taken
    for langs in blocks:
        own = grams if len(blocks) == 1 else grams.filter(F.col("lang").isin(langs))
        yield _trees(own.collect(), known)


def _predict(shared):
    """The best language of a block (null: none to tell), its code length, and the likelihoods of all, that of the best being 1."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: ContextTrees = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, least, sums = [None] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
            rows = [row for row, (text, letter) in enumerate(zip(texts, batch.column("letter").to_pylist())) if text and letter]
            if rows:
                data = np.frombuffer(b"".join(texts[row] for row in rows), dtype=np.uint8)
                begins = np.concatenate([[0], np.cumsum([len(texts[row]) for row in rows])])
                lengths = trees.lengths(data, begins)
                best = lengths.min(axis=1, keepdims=True)
                likely = np.exp2(np.maximum(best - lengths, FAINT)).sum(axis=1)
                for row, place, bits, total in zip(rows, lengths.argmin(axis=1).tolist(), best[:, 0].tolist(), likely.tolist()):
                    langs[row], least[row], sums[row] = trees.langs[place], bits, total
            found = [pa.array(langs, pa.string()), pa.array(least, pa.float64()), pa.array(sums, pa.float64())]
            yield pa.record_batch([batch.column(name) for name in KEPT] + found, [*KEPT, "lang", "bits", "likely"])

    return emit


def _of_all_blocks(texts: DataFrame, passes: list[DataFrame]) -> DataFrame:
    """The best of the blocks' answers for every row of ``texts``.

    A row's answers are the same for all rows equal in id and tag, so one of each block is kept and they are joined back.
    """
    answer = F.struct("bits", "lang", "likely")
    numbered = [df.filter("lang is not null").withColumn("block", F.lit(place)) for place, df in enumerate(passes)]
    answers = reduce(DataFrame.unionAll, numbered).groupBy("doc_id", "tag", "block").agg(F.min(answer).alias("answer"))
    best = answers.groupBy("doc_id", "tag").agg(F.collect_list("answer").alias("all")).withColumn("best", F.array_min("all"))
    share = lambda one: one["likely"] * F.pow(F.lit(2.0), F.greatest(F.col("best.bits") - one["bits"], F.lit(float(FAINT))))
    best = best.select(
        F.col("doc_id").alias("b_id"), F.col("tag").alias("b_tag"), F.col("best.lang").alias("lang"),
        F.aggregate("all", F.lit(0.0), lambda total, one: total + share(one)).alias("likely"),
    )
    return texts.drop("text").join(best, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("tag") == F.col("b_tag")), "left")


def identify_language(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 5,
    sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, held_out, lang_pred, score.

    Learns from documents whose crc32(id as text) mod ``folds`` is not 0, from a
    sample of about ``sample_docs`` texts a language, of any length, with
    ``sample_docs * sample_bytes`` bytes together (one text may have more).  ``score`` is the share of the best language when code lengths are
    taken as likelihoods.  A null text, or one without a letter, is ``und`` with
    score 0, and so is every text when there is nothing to learn from.  A null
    id counts as empty text in the fold; ties go to the first language by code
    point.  Repeated rows are judged one by one.  Other columns are not looked
    at.  An empty table gives an empty result.
    """
    return identify_letters(docs, doc_id, text, lang, folds, sample_docs, sample_bytes).drop("letter")


def identify_letters(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 5,
    sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """As ``identify_language``, and whether the text has a letter (``letter``)."""
    rows = pick(docs, doc_id=doc_id, text=text, lang=lang)
    rows = rows.withColumn("held_out", crc_part(F.col("doc_id"), folds) == 0).withColumn("tag", text_tag(F.col("text")))
    texts = rows.select(
        "doc_id", "tag", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.col("text").cast("binary").alias("text")
    )
    context = docs.sparkSession.sparkContext
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tag long, held_out boolean, letter boolean, lang string, bits double, likely double"
    passes = [texts.mapInArrow(_predict(context.broadcast(trees)), schema) for trees in train(rows.filter("not held_out"), sample_docs, sample_bytes)]
    if not passes:
        found = texts.withColumns({"lang": F.lit(None).cast("string"), "likely": F.lit(1.0)})
    else:
        found = passes[0] if len(passes) == 1 else _of_all_blocks(texts, passes)
    none = F.col("lang").isNull()
    return found.select(
        *KEPT, F.when(none, UNKNOWN).otherwise(F.col("lang")).alias("lang_pred"), F.when(none, 0.0).otherwise(1 / F.col("likely")).alias("score")
    )
