"""Substring deduplication by hashing lines or paragraphs.

Every text is cut into units, lines or paragraphs.  A unit's digest is the one
of its words, without regard to the white space between them and with A-Z in lower case.
Digests are grouped over all documents; the first occurrence, by document id
and place, stays, all later ones are removed.  What is removed is told in
places of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import land, pick, text_tag

# What ends a unit and belongs to it.
ENDS = {"line": re.compile("\n"), "paragraph": re.compile("\n(?:[\\x20\\x09\\x0B-\\x0D]*\n)+")}
ROWS = 20_000
SPANS = "array<struct<start:bigint,end:bigint,first_doc_id:{}>>"


def unit_places(text: str, unit: str) -> list[tuple[int, int]]:
    """Start and end of each unit, in code points; a text ends with a unit, which may be empty."""
    ends = [found.end() for found in ENDS[unit].finditer(text)]
    return list(zip([0, *ends], [*ends, len(text)]))


def _units(unit: str, min_words: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, starts, ends, digests = [], [], [], []

            def flush() -> pa.RecordBatch:
                own = pa.array(owners, pa.int64())
                columns = [batch.column("doc_id").take(own), batch.column("tag").take(own)]
                columns += [pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())]
                return pa.record_batch(columns, ["doc_id", "tag", "start", "end", "digest"])

            for row, text in enumerate(batch.column("text").to_pylist()):
                for start, end in unit_places(text, unit):
                    words = text[start:end].encode().lower().split()  # bytes: A-Z and ASCII white space only
                    if len(words) >= min_words:
                        owners.append(row)
                        starts.append(start)
                        ends.append(end)
                        digests.append(hashlib.sha256(b" ".join(words)).digest()[:16])
                if len(owners) >= ROWS:
                    yield flush()
                    owners, starts, ends, digests = [], [], [], []
            yield flush()

    return emit


def _cut(unit: str):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, units = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                sizes.append(len(text))
                units.append(len(ENDS[unit].findall(text)) + 1)
                at, pieces = 0, []
                for span in spans:
                    pieces.append(text[at : span["start"]])
                    at = span["end"]
                kept.append("".join([*pieces, text[at:]]))
            columns = {name: batch.column(name) for name in ("doc_id", "tag", "spans")}
            columns |= {"n_chars": pa.array(sizes, pa.int64()), "n_units": pa.array(units, pa.int64()), "kept_text": pa.array(kept, pa.string())}
            yield pa.record_batch(list(columns.values()), list(columns))

    return emit


def dedup_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, spans, n_chars, n_units, kept_text.

    Units of fewer than ``min_words`` words always stay: short lines come up by
    chance.  ``spans`` lists what is removed, in order, as structs of start and
    end (code points of the original text; the unit's end mark is part of it)
    and first_doc_id, the document whose occurrence stays.  Null and empty texts
    are one empty unit.  A null id comes after all others; rows equal in id and
    text are the same document and get the same answer.  Other columns are not
    looked at.  An empty table gives an empty result.
    """
    if unit not in ENDS:
        raise ValueError(f"unit is one of {sorted(ENDS)}, not {unit!r}")
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("tag", text_tag(F.col("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    units = rows.mapInArrow(_units(unit, min_words), f"doc_id {kind}, tag long, start long, end long, digest binary")
    units = land(units)
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tag"), F.col("start"))
    firsts = units.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Joined on another form of the key, both sides are shuffled, and Spark splits the tasks of common units.
    firsts = firsts.select(F.concat("digest", F.lit(b"+")).alias("other"), "first")
    later = units.join(firsts, F.concat("digest", F.lit(b"+")) == F.col("other")).filter(place != F.col("first"))
    span = F.struct("start", "end", F.col("first.doc_id").alias("first_doc_id"))
    spans = later.groupBy(F.col("doc_id").alias("other_id"), F.col("tag").alias("other_tag")).agg(F.array_sort(F.collect_set(span)).alias("spans"))
    mine = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("tag") == F.col("other_tag"))
    shape = SPANS.format(kind)
    found = rows.join(spans, mine, "left").select("doc_id", "tag", "text", F.coalesce("spans", F.array().cast(shape)).alias("spans"))
    return found.mapInArrow(_cut(unit), f"doc_id {kind}, tag long, spans {shape}, n_chars long, n_units long, kept_text string")
