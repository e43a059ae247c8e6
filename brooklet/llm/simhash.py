"""SimHash near-deduplication through an index of byte positions.

A fingerprint has 8 bytes.  Fingerprints that differ in at most 4 bits differ
in at most 4 bytes, so they share at least 4 bytes at the same positions.  The
index has a posting for the values at 3 positions; the 20 triples are a covering:
any 4 of the 8 positions contain one of them, so every such pair meets in a
posting.  For pairs in a posting the shared positional bytes are tallied, pairs
below the guaranteed minimum are let go, the others are verified bit by bit.
Fingerprints are indexed once, however many documents have them.

A posting gives the edges of a spanning forest of its links, not all pairs: a
fingerprint reached once is not compared again.  Postings above ``posting_rows``
fingerprints are dealt out by midpoints instead: within a posting, fingerprints
at most 4 bits apart have a common word at most 2 bits from each, so each is
sent to all words that near, and those that meet are in one component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import land, pick, text_tag
from brooklet.llm.components import connected

SHINGLE, SEED = 4, 42
MAX_BITS, MIN_BYTES = 4, 4
PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LANES = np.arange(8) * 256
SLAB = 1 << 16  # shingles counted at once


def covering(parts: tuple = PARTS) -> list[tuple[int, ...]]:
    """Triples of positions such that any four positions contain one: three of a part, or two of a part and one of the next."""
    inside = [triple for part in parts for triple in combinations(part, 3)]
    across = [(*two, one) for part, after in zip(parts, parts[1:] + parts[:1]) for two in combinations(part, 2) for one in after]
    return inside + across


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash over the XXH64 values of the text's word shingles; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins, ends = (ends - sizes).tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    ones, n = np.zeros((8, 8), dtype=np.int64), len(ends)
    for at in range(0, n, SLAB):
        pieces = [line[begin:end] for begin, end in zip(begins[at : at + SLAB], ends[at : at + SLAB])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype=np.uint64, count=len(pieces))
        by_byte = hashes.view(np.uint8).reshape(-1, 8) + LANES
        ones += np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((2 * ones > n).ravel(), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column("text")], dtype=np.uint64)
        yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), pa.array(found.view(np.int64))], ["doc_id", "tag", "print"])


def _near(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which ``others`` are linked to ``one``: tally of equal bytes first, then the bits."""
    differ = others ^ one
    near = np.zeros(len(others), dtype=bool)
    enough = np.flatnonzero((differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_BYTES)
    near[enough] = np.bitwise_count(differ[enough]) <= MAX_BITS
    return near


def _forest(prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Edges (one, others) that connect what is linked; each print is reached once."""
    waiting = prints
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            one = front.pop()
            near = _near(one, waiting)
            if near.any():
                reached, waiting = waiting[near], waiting[~near]
                front.extend(reached)
                yield one, reached


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within the postings of a partition that is sorted by posting."""

    def edges(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        sizes = np.diff(np.append(begins, len(keys)))
        two = begins[sizes == 2]
        differ = prints[two] ^ prints[two + 1]
        enough = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_BYTES
        linked = two[enough & (np.bitwise_count(differ) <= MAX_BITS)]
        a, b = [prints[linked]], [prints[linked + 1]]
        for begin, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for one, others in _forest(prints[begin : begin + size]):
                a.append(np.full(len(others), one))
                b.append(others)
        a, b = (np.concatenate(x).view(np.int64) for x in (a, b))
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("posting").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last posting may go on
        if cut:
            yield from edges(keys[:cut], prints[:cut])
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield from edges(keys, prints)


def _midpoints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    triples = covering()
    for batch in batches:
        keys = batch.column("posting").to_numpy(zero_copy_only=False)
        prints = batch.column("print").to_numpy(zero_copy_only=False)
        for key, one in zip(keys.tolist(), prints.view(np.uint64)):
            free = [8 * byte + bit for byte in range(8) if byte not in triples[key >> 24] for bit in range(8)]
            flips = [0, *(1 << bit for bit in free), *((1 << x) | (1 << y) for x, y in combinations(free, 2))]
            middle = (np.array(flips, dtype=np.uint64) ^ one).view(np.int64)
            size = len(middle)
            yield pa.record_batch([pa.array([key] * size, pa.int64()), pa.array(middle), pa.array(np.full(size, one).view(np.int64))], ["posting", "middle", "print"])


def _postings(prints: DataFrame) -> DataFrame:
    def byte(place: int) -> Column:
        return F.shiftrightunsigned("print", 8 * place).bitwiseAND(F.lit(255))

    def key(number: int, triple: tuple[int, ...]) -> Column:
        values = F.lit(number << 24).cast("long")
        for slot, place in enumerate(triple):
            values = values + byte(place) * (1 << (8 * slot))
        return values

    keys = F.array(*[key(number, triple) for number, triple in enumerate(covering())])
    return prints.select(F.explode(keys).alias("posting"), "print")


def near_links(prints: DataFrame, posting_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct ``prints`` (print)."""
    postings = _postings(prints)
    counts = land(postings.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = postings.join(counts.filter(F.col("n") <= posting_rows).select("posting"), "posting")
    edges = met.repartition("posting").sortWithinPartitions("posting").mapInArrow(_links, "a long, b long")
    large = counts.filter(F.col("n") > posting_rows).select("posting")
    if not large.isEmpty():
        spread = postings.join(large, "posting").select("posting", "print").mapInArrow(_midpoints, "posting long, middle long, print long")
        least = spread.groupBy("posting", "middle").agg(F.min("print").alias("b"))
        edges = edges.unionByName(spread.join(least, ["posting", "middle"]).select(F.col("print").alias("a"), "b").filter("a <> b"))
    return edges


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", posting_rows: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, fingerprint (hex), component_id, kept.

    Documents whose fingerprints differ in at most 4 bits are linked;
    ``component_id`` is the smallest id reachable through links; a null id comes
    after all others.  ``kept`` is true for one (doc_id, tag) of each component.
    Null and empty texts have fingerprint 0.  Rows with the same id are judged
    by their own texts.  Other columns are not looked at.  An empty table gives
    an empty result.
    """
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", text_tag(F.col("text")).alias("tag"), F.col("text").cast("binary").alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = land(rows.mapInArrow(_fingerprints, f"doc_id {kind}, tag long, print long"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tag"))
    prints = land(rows.groupBy("print").agg(F.min(rank).alias("best")))
    labels = connected(near_links(prints.select("print"), posting_rows))
    placed = prints.join(labels, F.col("print") == F.col("node"), "left")
    placed = land(placed.select("print", "best", F.coalesce("label", "print").alias("label")))
    first = placed.groupBy("label").agg(F.min("best").alias("first"))
    answers = placed.join(first, "label").select("print", "first")
    return rows.join(answers, "print").select(
        "doc_id",
        "tag",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (rank == F.col("first")).alias("kept"),
    )
