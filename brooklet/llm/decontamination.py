"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Every benchmark item gives windows of ``width`` consecutive words.  A window is
the set of its shingles (``shingle`` words each); a document contains the window
only if it contains all of them, so joining on one of them, the necessary
prefix at containment 1, loses nothing.  The prefix is the rarest shingle: a
first pass over the documents counts the benchmark's shingles.  Windows with a
shingle that no document has are out at once.  The second pass looks up the
prefix shingles, bounds the place of the window by the shingle's position in
both texts and by the length of the text, and compares all words of the window.

Both passes read the documents where they are and move none of them.  The benchmark is sent to
the tasks in blocks of at most ``block`` windows each; a larger benchmark takes
more passes over the same rows, not a larger broadcast.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import land, pick, text_tag

# Bytes that are part of words: digits, letters, everything that is not ASCII.  A-Z becomes a-z, the rest blanks.
WORD_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
BETWEEN = b"|"  # no word contains it
CHUNK = 4 << 20  # bytes of text handled at once; a longer text is a chunk of its own
ROWS = 10_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def _windows(width: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                size = min(width, len(words))
                starts = range(len(words) - size + 1 if words else 0)
                for at in range(0, len(starts), ROWS):
                    found = [b" ".join(words[start : start + size]).decode("utf-8", "replace") for start in starts[at : at + ROWS]]
                    yield pa.record_batch([pa.array([item] * len(found), pa.string()), pa.array(found, pa.string())], ["item", "window"])

    return emit


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = 13) -> DataFrame:
    """Distinct (item, window) of the items: ``width`` words, or all words of a shorter item, with blanks between."""
    rows = pick(items, item=item_id, text=text).select(F.col("item").cast("string"), F.col("text").cast("binary"))
    return rows.mapInArrow(_windows(width), "item string, window string").distinct()


class _Block:
    """What a task needs to find shingles: numbers of the words, and codes of the shingles by their length."""

    def __init__(self, shingles: Iterable[str]) -> None:
        self.words: dict[bytes, int] = {}
        codes = defaultdict(dict)
        shingles = list(shingles)
        longest = max((shingle.count(" ") + 1 for shingle in shingles), default=0)
        self.factors = np.random.default_rng(7).integers(1, 1 << 62, longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for shingle in shingles:
            ids = self.number(shingle)
            codes[len(ids)].setdefault(int(self.code(ids, len(ids))[0]), []).append(shingle)
        self.shingles = {size: dict(sorted(found.items())) for size, found in codes.items()}
        self.codes = {size: np.array(list(found), dtype=np.uint64) for size, found in self.shingles.items()}

    def number(self, text: str) -> np.ndarray:
        return np.array([self.words.setdefault(word, len(self.words) + 1) for word in text.encode().split(b" ")], dtype=np.uint64)

    def code(self, ids: np.ndarray, size: int) -> np.ndarray:
        last = len(ids) - size + 1
        total = np.zeros(last, dtype=np.uint64)
        for place in range(size):
            total += ids[place : place + last] * self.factors[place]
        return total

    def found(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, codes) of shingles that may be in ``ids``; 0 stands for other words."""
        for size, codes in self.codes.items():
            if len(ids) >= size:
                here = self.code(ids, size)
                near = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
                places = np.flatnonzero(codes[near] == here)
                yield size, places, here[places]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of about ``CHUNK`` bytes."""
    begin, size = 0, 0
    for place, text in enumerate(texts):
        if size and size + len(text or b"") > CHUNK:
            yield begin, place
            begin, size = place, 0
        size += len(text or b"") + 1
    if texts:
        yield begin, len(texts)


def _numbered(texts: list[bytes | None], block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of some texts, one after another with a 0 between; where each begins, and its number of words."""
    plain = [(text or b"").translate(WORD_BYTES) for text in texts]
    words = b" | ".join(plain).split()
    ids = np.fromiter(map(block.words.get, words, repeat(0)), dtype=np.uint64, count=len(words))
    bars = np.flatnonzero(np.fromiter(map(BETWEEN.__eq__, words), dtype=bool, count=len(words)))
    begins = np.concatenate([[0], bars + 1]).astype(np.int64)
    sizes = np.concatenate([bars, [len(words)]]).astype(np.int64) - begins
    return ids, begins, sizes


def _count(shared):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = shared.value, defaultdict(int)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in _chunks(texts):
                ids, _, _ = _numbered(texts[begin:end], block)
                for size, _, codes in block.found(ids):
                    for code, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True))):
                        for shingle in block.shingles[size][code]:
                            total[shingle] += n
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["shingle", "n"])

    return emit


def _mark(shared, last: bool):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = shared.value
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            texts, spans, items = (columns[name].to_pylist() for name in ("text", "spans", "items"))
            n_words, n_hit, hit_spans, hit_items = [], [], [], []
            for begin, end in _chunks(texts):
                _mark_chunk(block, index, texts[begin:end], spans[begin:end], items[begin:end], n_words, n_hit, hit_spans, hit_items)
            columns |= {
                "spans": pa.array(hit_spans, pa.list_(pa.int64())), "items": pa.array(hit_items, pa.list_(pa.string())),
                "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
            }
            if last:
                del columns["text"]
            yield pa.record_batch(list(columns.values()), list(columns))

    return emit


def _mark_chunk(block, index, texts, spans, items, n_words, n_hit, hit_spans, hit_items) -> None:
    ids, begins, sizes = _numbered(texts, block)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    found = defaultdict(set)
    for _, places, codes in block.found(ids):
        owners = np.searchsorted(begins, places, side="right") - 1
        for place, code, owner in zip(places.tolist(), codes.tolist(), owners.tolist()):
            for offset, window, names in index.get(code, ()):
                start = place - offset
                # The window must lie within the text that has the shingle.
                if start < begins[owner] or start + len(window) > begins[owner] + sizes[owner]:
                    continue
                if np.array_equal(ids[start : start + len(window)], window):
                    edges[start] += 1
                    edges[start + len(window)] -= 1
                    found[owner].update(names)
    known = [row for row, before in enumerate(spans) if before]
    for row in known:
        for start, end in zip(spans[row][::2], spans[row][1::2]):
            edges[begins[row] + start] += 1
            edges[begins[row] + end] -= 1
    hit = np.cumsum(edges) > 0
    for row, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist())):
        n_words.append(size)
        hit_items.append(sorted({*(items[row] or ()), *found.get(row, ())}))
        if row not in found and not spans[row]:
            n_hit.append(0)
            hit_spans.append([])
            continue
        mine = np.concatenate([[0], hit[begin : begin + size].view(np.int8), [0]])
        n_hit.append(int(mine.sum()))
        hit_spans.append(np.flatnonzero(np.diff(mine)).tolist())


def _blocks(df: DataFrame, block: int, *key: str) -> Iterator[list]:
    """The rows of ``df`` in parts of about ``block`` rows, one after another."""
    parts = math.ceil(df.count() / block)
    for part in range(parts):
        yield df.filter(F.pmod(F.xxhash64(*key), F.lit(parts)) == part).collect()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    shingle: int = 5,
    share: int = 20,
    block: int = 200_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, n_words, n_hit, spans, items, contaminated.

    A word is hit when it lies in an occurrence of a benchmark window; ``spans``
    has the hit words as start, end, start, end, ...; ``items`` the sorted ids of
    the items found, as text (an item without id marks words but is not
    listed).  Contaminated means that a word is hit, and at least one word of
    ``share``.  Null and empty texts have no words.  Repeated rows are judged one
    by one; repeated items count once.  Other columns are not looked at; empty
    tables give an empty result, or one without hits.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", text_tag(F.col("text")).alias("tag"), F.col("text").cast("binary").alias("text")
    )
    windows = land(benchmark_windows(benchmark, item_id, item_text, width))
    words = F.split("window", " ")
    windows = windows.withColumn("size", F.least(F.lit(shingle), F.size(words)))
    places = F.sequence(F.lit(0), F.size(words) - F.col("size"))
    parts = F.transform(places, lambda at: F.array_join(F.slice(words, at + 1, F.col("size")), " "))
    in_windows = windows.select("window").distinct().withColumn("size", F.least(F.lit(shingle), F.size(words)))
    in_windows = in_windows.select("window", F.size(parts).alias("parts"), F.posexplode(parts).alias("offset", "shingle"))

    counts = None
    for found in _blocks(land(in_windows.select("shingle").distinct()), block, "shingle"):
        shared = context.broadcast(_Block(row["shingle"] for row in found))
        counted = rows.select("text").mapInArrow(_count(shared), "shingle string, n long")
        counts = counted if counts is None else counts.unionByName(counted)
    marked = rows.select(
        "*", F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
    )
    passes = []
    if counts is not None:
        counts = counts.groupBy("shingle").agg(F.sum("n").alias("n"))
        prefixes = in_windows.join(counts, "shingle").groupBy("window", "parts").agg(
            F.count(F.lit(1)).alias("present"), F.min(F.struct("n", "shingle", "offset")).alias("rarest")
        )
        prefixes = prefixes.filter("present = parts").select("window", "rarest.shingle", "rarest.offset")
        passes = _blocks(land(windows.select("item", "window").join(prefixes, "window")), block, "window", "item")
    blocks = [_index(found) for found in passes] or [(_Block(()), {})]
    shape = "doc_id {0}, tag long{1}, spans array<bigint>, items array<string>, n_words long, n_hit long"
    kind = rows.schema["doc_id"].dataType.simpleString()
    for number, found in enumerate(blocks, 1):
        last = number == len(blocks)
        marked = marked.mapInArrow(_mark(context.broadcast(found), last), shape.format(kind, "" if last else ", text binary"))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return marked.select("doc_id", "tag", "n_words", "n_hit", "spans", "items", bad.alias("contaminated"))


def _index(found: list) -> tuple[_Block, dict]:
    """Codes of the prefix shingles, each with its (offset, window, items)."""
    block = _Block({row["shingle"] for row in found})
    names = defaultdict(list)
    for row in found:
        names[row["window"], row["shingle"], row["offset"]].append(row["item"])
    index = defaultdict(list)
    for (window, shingle, offset), items in names.items():
        ids = block.number(shingle)
        index[int(block.code(ids, len(ids))[0])].append((offset, block.number(window), [name for name in items if name is not None]))
    return block, dict(index)
