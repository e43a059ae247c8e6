"""Scoring texts with a hidden Markov language model.

A text is its words, lower-cased in A-Z, and an end token.  The most frequent
words are symbols of their own, and the more distinct words the corpus has, the
more of them (``words_each``); every other word is the symbol of its ending (one of ``endings`` classes), and within a class a word has
probability (count + 1) / (tokens + words + 1) of the class, the last 1 being all
unknown words.  A text's probability is that of its symbols under a hidden
Markov model, by the scaled forward recursion, times that of the words within
their classes.

Three passes over the texts: one counts the words, one turns the texts into
symbols, which are written once, and each Baum-Welch round reads the symbols: every
task sums the expected counts of its texts, Spark adds them up per symbol, and
the driver gets one row per symbol.  All training texts, however long, count in
every round; the starting point deviates at random from the symbols' counts in
all of them.

The counts of the ``shared_words`` most frequent words are sent to the tasks, so
what is broadcast has a fixed bound.  Occurrences of the many rare words are
joined with the distributed table of counts instead.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm import hmm
from brooklet.llm.common import crc_part, land, pick, scratch, text_tag

END = b"\n"  # no word contains it
HELD_WORDS = 400_000  # distinct words a task holds before it passes their counts on
START_ROW, MOVE_ROW, FIT_ROW = -1, -2, -1000
SYMBOL = np.uint16


@dataclass(frozen=True)
class Settings:
    states: int = 8
    own_words: int = 8192  # at least, if there are so many
    words_each: int = 128  # distinct words for one more symbol
    endings: int = 512
    shared_words: int = 200_000
    rounds: int = 5  # each over all training texts; more gain less than a hundredth of what these do
    weight: float = 20.0  # tokens by which the usual shares of the symbols count in every state
    seed: int = 0

    def for_words(self, distinct: int) -> Settings:
        """With the symbols for a corpus of so many distinct words; symbols are numbered in 16 bits, and so is the model's size bounded."""
        room = np.iinfo(SYMBOL).max - self.endings
        if self.own_words > room:
            raise ValueError(f"own_words and endings must stay below {np.iinfo(SYMBOL).max} together")
        return replace(self, own_words=min(max(self.own_words, distinct // self.words_each), room))

    @property
    def symbols(self) -> int:
        return self.own_words + self.endings + 1

    @property
    def end(self) -> int:
        return self.own_words + self.endings

    def ending(self, word: bytes) -> int:
        return zlib.crc32(word[-3:]) % self.endings


def _count(settings: Settings):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(found)
            endings = [-1 if word == END else settings.ending(word) for word in words]
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(endings, pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "ending", "n"])

        for batch in batches:
            for text in batch.column("text"):
                found.update((text.as_py() or b"").lower().split())  # bytes: A-Z and ASCII white space only
                if len(found) > HELD_WORDS:
                    yield flush()
                    found.clear()
            found[END] += batch.num_rows
        yield flush()

    return emit


@dataclass(frozen=True)
class Words:
    """What tasks need to turn words into symbols."""

    words: list[bytes]  # by count, most frequent first
    log_counts: np.ndarray  # log10(count + 1) of each
    symbols: np.ndarray  # symbol of each
    log_end: float
    end_known: bool


def _encode(shared, settings: Settings):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Words = shared.value
        number = {word: place for place, word in enumerate(table.words)}
        nowhere = len(table.words)
        # One more entry for words that are not shared.
        log_counts, symbols = np.append(table.log_counts, 0.0), np.append(table.symbols, 0).astype(SYMBOL)
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in ("n_tokens", "symbols", "n_shared", "shared_base", "shared_within", "rare")}
            for text in batch.column("text"):
                words = (text.as_py() or b"").lower().split()
                places = np.fromiter(map(number.get, words, repeat(nowhere)), dtype=np.int64, count=len(words))
                sequence = np.empty(len(words) + 1, dtype=SYMBOL)
                sequence[:-1] = symbols[places]
                sequence[-1] = settings.end
                rare = np.flatnonzero(places == nowhere)
                rare_words = [words[place] for place in rare.tolist()]
                sequence[rare] = [settings.own_words + settings.ending(word) for word in rare_words]
                logs = log_counts[places]
                columns["n_tokens"].append(len(words) + 1)
                columns["symbols"].append(sequence.tobytes())
                columns["n_shared"].append(len(words) - len(rare) + table.end_known)
                columns["shared_base"].append(float(logs.sum()) + table.log_end)
                columns["shared_within"].append(float(logs[sequence[:-1] >= settings.own_words].sum()))
                columns["rare"].append(rare_words)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            made = [pa.array(values, kind) for values, kind in zip(columns.values(), kinds)]
            yield pa.record_batch([batch.column(name) for name in ("doc_id", "tag", "held_out")] + made, ["doc_id", "tag", "held_out", *columns])

    return emit


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    begins = np.concatenate([[0], np.cumsum([len(part) // SYMBOL().itemsize for part in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype=SYMBOL), begins


def _expect(shared):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: hmm.Hmm = shared.value
        counts = hmm.Counts.none(*model.emit.shape)
        for batch in batches:
            if batch.num_rows:
                hmm.expect(model, *_sequences(batch.column("symbols")), counts)
        states = len(model.start)
        seen = np.flatnonzero(counts.emit.any(axis=1))
        rows = [*seen.tolist(), START_ROW, *(MOVE_ROW - state for state in range(states)), FIT_ROW]
        fit = np.zeros((1, states))
        fit[0, 0] = counts.log_likelihood
        values = np.concatenate([counts.emit[seen], counts.start[None], counts.move, fit])
        yield pa.record_batch([pa.array(rows, pa.int64())] + [pa.array(values[:, state]) for state in range(states)], ["row", *(f"s{state}" for state in range(states))])

    return emit


def _score(shared):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_class = shared.value
        kept = ["row", "doc_id", "tag", "held_out", "n_tokens", "n_shared", "shared_base", "shared_within"]
        for batch in batches:
            fit = within = np.zeros(0)
            if batch.num_rows:
                data, begins = _sequences(batch.column("symbols"))
                fit = hmm.log_likelihoods(model, data, begins) / math.log(10)
                within = np.add.reduceat(log_class[data], begins[:-1])
            yield pa.record_batch([batch.column(name) for name in kept] + [pa.array(fit), pa.array(within)], [*kept, "fit", "class_sizes"])

    return emit


def baum_welch(spark: SparkSession, texts: DataFrame, model: hmm.Hmm) -> hmm.Counts:
    """Expected counts over all ``texts`` (symbols), summed per symbol by Spark."""
    states = len(model.start)
    names = [f"s{state}" for state in range(states)]
    parts = texts.select("symbols").mapInArrow(_expect(spark.sparkContext.broadcast(model)), "row long, " + ", ".join(f"{name} double" for name in names))
    summed = parts.groupBy("row").agg(*[F.sum(name).alias(name) for name in names]).toArrow()  # a row per symbol
    rows = summed.column("row").to_numpy()
    values = np.stack([summed.column(name).to_numpy() for name in names], axis=1)
    counts = hmm.Counts.none(*model.emit.shape)
    counts.emit[rows[rows >= 0]] = values[rows >= 0]
    for row, value in zip(rows.tolist(), values):
        if row == START_ROW:
            counts.start = value
        elif row == FIT_ROW:
            counts.log_likelihood = float(value[0])
        elif row < 0:
            counts.move[MOVE_ROW - row] = value
    return counts


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words: all whose count is at least a bound, and not more than ``most``."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("words"))
    bound, words = None, 0
    for row in sorted(steps.collect(), key=lambda row: -row["step"]):  # eight per doubling of a count: a few hundred
        words += row["words"]
        if words > most:
            break
        bound = row["n"]
    return counts.filter(F.col("n") >= bound if bound is not None else F.lit(False))


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_fold: int = 2, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all documents whose crc32(id as text) mod ``folds`` is not
    ``held_fold`` (a null id counts as empty text).  ``base_score`` is the log10
    probability under add-one smoothed word counts, ``score`` that of the model.
    Null and empty texts are the end token alone.  Repeated rows count and are
    scored one by one.  Other columns are not looked at.  An empty table gives an
    empty result; without training documents every word is unknown.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id",
        text_tag(F.col("text")).alias("tag"),
        (crc_part(F.col("doc_id"), folds) == held_fold).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    counted = rows.filter("not held_out").select("text").mapInArrow(_count(settings), "word binary, ending int, n long")
    counts = land(counted.groupBy("word", "ending").agg(F.sum("n").alias("n")))
    n_words, n_tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    settings = settings.for_words(n_words)
    words, log_class, symbol_counts = _words(counts, settings)

    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, tag long, held_out boolean, n_tokens long, symbols binary, n_shared long, shared_base double, shared_within double, rare array<binary>"
    encoded = rows.mapInArrow(_encode(spark.sparkContext.broadcast(words), settings), shape).withColumn("row", F.monotonically_increasing_id())
    path = scratch(spark, "symbols")
    encoded.write.parquet(path)
    stored = spark.read.schema(encoded.schema).parquet(path)

    model = _train(spark, stored.filter("not held_out"), symbol_counts, settings)
    names = "row long, doc_id {}, tag long, held_out boolean, n_tokens long, n_shared long, shared_base double, shared_within double, fit double, class_sizes double"
    scored = stored.drop("rare").mapInArrow(_score(spark.sparkContext.broadcast((model, log_class))), names.format(kind))
    rare = stored.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_base"))
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    all_events = math.log10(n_tokens + n_words + 1)
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "tag",
        "held_out",
        "n_tokens",
        (F.col("n_shared") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("shared_base") + rare_base - F.col("n_tokens") * F.lit(all_events)).alias("base_score"),
        (F.col("fit") + F.col("shared_within") + rare_base - F.col("class_sizes")).alias("score"),
    )


def _words(counts: DataFrame, settings: Settings) -> tuple[Words, np.ndarray, np.ndarray]:
    """The shared words, log10(tokens + words + 1) of the class of each symbol (0 for symbols that are one word), and the tokens of each symbol."""
    frequent = _frequent(counts.filter("ending >= 0"), settings.shared_words).toArrow().to_pydict()
    order = sorted(range(len(frequent["word"])), key=lambda at: (-frequent["n"][at], frequent["word"][at]))
    own = order[: settings.own_words]
    symbols = [place if place < len(own) else settings.own_words + frequent["ending"][at] for place, at in enumerate(order)]
    ends = counts.filter("ending < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    events = np.zeros(settings.endings)  # tokens + words of each class
    tokens = np.zeros(settings.symbols)
    classes = counts.filter("ending >= 0").groupBy("ending").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"))
    for row in classes.collect():
        events[row["ending"]] = row["tokens"] + row["words"]
        tokens[settings.own_words + row["ending"]] = row["tokens"]
    for place, at in enumerate(own):
        events[frequent["ending"][at]] -= frequent["n"][at] + 1
        tokens[settings.own_words + frequent["ending"][at]] -= frequent["n"][at]
        tokens[place] = frequent["n"][at]
    tokens[settings.end] = ends
    log_class = np.zeros(settings.symbols)
    log_class[settings.own_words : settings.end] = np.log10(events + 1)
    logs = np.log10(np.array([frequent["n"][at] for at in order], dtype=np.float64) + 1)
    table = Words([frequent["word"][at] for at in order], logs, np.array(symbols, dtype=SYMBOL), math.log10(ends + 1), ends > 0)
    return table, log_class, tokens


def _train(spark: SparkSession, texts: DataFrame, symbol_counts: np.ndarray, settings: Settings) -> hmm.Hmm:
    usual = symbol_counts + 0.5
    usual /= usual.sum()
    model = hmm.beginning(usual, settings.states, settings.seed)
    for _ in range(settings.rounds if symbol_counts.any() else 0):
        model = hmm.maximise(baum_welch(spark, texts, model), usual, settings.weight)
    return model
