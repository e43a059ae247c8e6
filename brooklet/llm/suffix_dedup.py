"""Removing long repeated byte strings with a sparse suffix array.

A string of ``match`` bytes that starts at two places has the same smallest
``gram`` (by hash) at both, so it is enough to look at anchors: places whose gram is the
smallest of some stretch of ``match`` bytes.  Anchors with a gram of their own
are let go; the others are brought together by gram, each with the bytes around
it.  Within a gram the suffixes that begin at the anchors are put in order by deep-shallow
sorting, and so are the reversed prefixes that end there.  Neighbours'
common prefixes then tell, for every place ``left`` bytes ahead of an anchor,
whether the string that starts there starts elsewhere too.

Grams with more than ``group_rows`` anchors (a passage that very many documents
have) are not brought together as they are.  The places ahead of an anchor are
halved again and again; anchors that agree on all the bytes of a half's strings
settle it by their count and leave one of them behind, anchors that agree with nobody on the bytes common to
all of the half's strings drop out, and groups that are small enough by now are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brooklet.llm.common import land, pick, scratch, text_tag
from brooklet.llm.suffix_sort import deep_shallow

MATCH, GRAM = 400, 160
CHUNK = 1 << 20  # bytes looked at together; longer texts are cut into overlapping pieces
FACTOR = 0x9E3779B97F4A7C15  # any odd number; its powers weigh the bytes of a gram
FEW = 12  # anchors that are compared pair by pair after sorting


# --- anchors


def _slide(values: np.ndarray, size: int, pick_one: np.ufunc) -> np.ndarray:
    """Smallest or largest of every ``size`` neighbours."""
    span, found = 1, values
    while 2 * span <= size:
        found = pick_one(found[:-span], found[span:])
        span *= 2
    rest = size - span
    return pick_one(found[: len(found) - rest], found[rest:]) if rest else found


class _Anchors:
    def __init__(self, match: int, gram: int) -> None:
        self.match, self.gram = match, gram
        powers = np.full(CHUNK + 1, FACTOR, dtype=np.uint64)
        inverse = np.full(CHUNK + 1, pow(FACTOR, -1, 1 << 64), dtype=np.uint64)
        powers[0] = inverse[0] = 1
        self.powers, self.inverse = np.cumprod(powers), np.cumprod(inverse)

    def find(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and gram hashes of the anchors of ``data``; texts lie between ``begins`` and are not crossed."""
        starts = len(data) - self.match + 1
        if starts <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(data * self.powers[: len(data)], out=sums[1:])
        grams = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: len(data) - self.gram + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        rank = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        width = self.match - self.gram + 1
        least = _slide(rank, width, np.minimum)
        inside = np.zeros(starts, dtype=bool)  # strings that end in the text they start in
        for begin, end in zip(begins[:-1], begins[1:]):
            inside[begin : max(begin, end - self.match + 1)] = True
        least = np.where(inside, least[:starts], 0)
        padded = np.zeros(len(rank) + width - 1, dtype=np.uint32)
        padded[width - 1 : width - 1 + starts] = least
        places = np.flatnonzero(_slide(padded, width, np.maximum) == rank)
        return places, grams[places]


def _pieces(texts: list[bytes | None], match: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in lists of at most CHUNK bytes; pieces of a text share the strings at their borders."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < match:
            continue
        for offset in range(0, max(1, len(text) - match + 1), CHUNK - match + 1):
            piece = text[offset : offset + CHUNK]
            if size + len(piece) > CHUNK:
                yield held
                held, size = [], 0
            held.append((row, offset, piece))
            size += len(piece)
    if held:
        yield held


def _anchor_rows(match: int, gram: int):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Anchors(match, gram)
        for batch in batches:
            for pieces in _pieces(batch.column("text").to_pylist(), match):
                data = np.frombuffer(b"".join(piece for _, _, piece in pieces), dtype=np.uint8)
                begins = np.concatenate([[0], np.cumsum([len(piece) for _, _, piece in pieces])])
                places, grams = finder.find(data, begins)
                which = np.searchsorted(begins, places, side="right") - 1
                rows = np.array([row for row, _, _ in pieces])[which]
                at = places - begins[which] + np.array([offset for _, offset, _ in pieces])[which]
                take = pa.array(rows)
                yield pa.record_batch(
                    [batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array(grams.view(np.int64)), pa.array(at)],
                    ["doc_id", "tag", "gram", "at"],
                )

    return emit


# --- the bytes around repeated anchors


def _contexts(match: int, gram: int, shape: pa.Schema, hot: bool):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, tag, text, anchors in zip(*(batch.column(name) for name in ("doc_id", "tag", "text", "anchors"))):
                text = text.as_py()
                for anchor in anchors.as_py():
                    if anchor["hot"] == hot:
                        at = anchor["at"]
                        before = text[max(0, at - match + gram) : at][::-1]
                        rows.append((anchor["gram"], doc_id.as_py(), tag.as_py(), at, before, text[at : at + match]))
                if len(rows) >= 5_000:
                    yield _batch(rows, shape)
                    rows = []
            yield _batch(rows, shape)

    return emit


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(shape)
    return pa.record_batch([pa.array(column, field.type) for column, field in zip(columns, shape)], schema=shape)


# --- which strings around the anchors of a group are repeated


def repeated(before: list[bytes], after: list[bytes], low: int, high: int, match: int) -> list[tuple[int, int] | None]:
    """For each anchor the smallest and largest ``left`` from ``low`` to ``high`` whose string another anchor has too.

    The string of ``left`` has the first ``left`` bytes of the reversed
    ``before`` and the first ``match - left`` bytes of ``after``.  Every string
    between the two holds the anchor, so together they cover one stretch.
    """
    n = len(before)
    found: list[tuple[int, int] | None] = [None] * n
    right, right_common = deep_shallow(after)
    left, left_common = deep_shallow(before)
    if n <= FEW:
        ahead = _pair_common(left, left_common)
        behind = _pair_common(right, right_common)
        for one in range(n):
            for two in range(one + 1, n):
                least, most = max(low, match - behind[one][two]), min(high, ahead[one][two])
                if least <= most:
                    for anchor in (one, two):
                        known = found[anchor]
                        found[anchor] = (least, most) if known is None else (min(least, known[0]), max(most, known[1]))
        return found
    before_size = np.array([len(text) for text in before])
    after_size = np.array([len(text) for text in after])
    left, left_common, right, right_common = (np.array(x) for x in (left, left_common, right, right_common))
    # Only at these places can the groups of equal strings change.
    turns = np.unique(np.concatenate([[low], left_common + 1, match - right_common, before_size + 1, match - after_size]))
    turns = turns[(turns >= low) & (turns <= high)]
    least, most = np.full(n, high + 1), np.full(n, low - 1)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    for turn, until in zip(turns, np.append(turns[1:] - 1, high)):
        ahead[left] = np.cumsum(left_common < turn)
        behind[right] = np.cumsum(right_common < match - turn)
        here = np.flatnonzero((before_size >= turn) & (after_size >= match - turn))
        _, group, size = np.unique(ahead[here] * (n + 1) + behind[here], return_inverse=True, return_counts=True)
        here = here[size[group] > 1]
        least[here] = np.minimum(least[here], turn)
        most[here] = until
    return [(int(a), int(b)) if a <= b else None for a, b in zip(least, most)]


def _pair_common(order: list[int], neighbours: list[int]) -> list[list[int]]:
    """Common prefix of every two, as the smallest between them in sorted order."""
    table = [[0] * len(order) for _ in order]
    for place, one in enumerate(order):
        shared = None
        for later in range(place + 1, len(order)):
            shared = neighbours[later] if shared is None else min(shared, neighbours[later])
            table[one][order[later]] = table[order[later]][one] = shared
    return table


def _sorted_groups(match: int, shape: pa.Schema):
    """Stretches found in each group (key) of a partition sorted by key."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        rows: list[tuple] = []

        def settle() -> None:
            spans = repeated([x["before"] for x in held], [x["after"] for x in held], held[0]["low"], held[0]["high"], match)
            rows.extend((x["doc_id"], x["tag"], x["at"] - span[1], x["at"] + match - span[0]) for x, span in zip(held, spans) if span and not x["left_behind"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["key"] != row["key"]:
                    if len(held) > 1:
                        settle()
                    held = []
                held.append(row)
            if len(rows) >= 5_000:
                yield _batch(rows, shape)
                rows = []
        if len(held) > 1:
            settle()
        yield _batch(rows, shape)

    return emit


# --- grams with very many anchors


def _digests(match: int):
    """Digests of what all strings of a half share, and of all the bytes of its strings, if they fit into the text.

    Where they do not, the second digest is that of the place, so that it is never common.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, cores, wholes, fitting = [], [], [], []
            columns = (batch.column(name).to_pylist() for name in ("gram", "before", "after", "low", "high", "doc_id", "tag", "at"))
            for place, (gram, before, after, low, high, *where) in enumerate(zip(*columns)):
                if len(before) < low or len(after) < match - high:
                    continue  # no string of this half fits into the text
                kept.append(place)
                key = b"%d %d %d " % (gram, low, high)
                cores.append(hashlib.sha256(key + before[:low] + b" " + after[: match - high]).digest()[:16])
                fitting.append(len(before) >= high and len(after) >= match - low)
                whole = before[:high] + b" " + after[: match - low] if fitting[-1] else repr(where).encode()
                wholes.append(hashlib.sha256(key + whole).digest()[:16])
            rows = batch.take(pa.array(kept, pa.int64()))
            marks = [pa.array(cores, pa.binary()), pa.array(wholes, pa.binary()), pa.array(fitting, pa.bool_())]
            yield pa.record_batch([*rows.columns, *marks], [*rows.schema.names, "core", "whole", "fits"])

    return emit


def _other(digest: str) -> Column:
    return F.concat(F.col(digest), F.lit(b"+"))


def _halved(anchors: DataFrame, match: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(settled stretches, groups to sort) of hot grams; see the module's text."""
    settled = groups = None
    shape = anchors.schema.simpleString()[len("struct<") : -1]
    active = anchors
    while True:
        marked = active.mapInArrow(_digests(match), f"{shape},core:binary,whole:binary,fits:boolean")
        # Rows of one whole settle each other; a lone row with the same core may still have a partner.
        wholes = marked.filter("fits").groupBy("whole").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("left_behind", "doc_id", "tag", "at")).alias("one")
        )
        # Joined on another form of the key, both sides are shuffled, and Spark splits the tasks of common keys.
        wholes = wholes.filter("n > 1").select(_other("whole").alias("same"), "n", "one")
        marked = land(marked.join(wholes, _other("whole") == F.col("same"), "left").drop("same", "fits"))
        done = marked.filter("n > 1 and not left_behind").select(
            "doc_id", "tag", (F.col("at") - F.col("high")).alias("start"), (F.col("at") + match - F.col("low")).alias("end")
        )
        settled = done if settled is None else settled.unionByName(done)
        me = F.struct("left_behind", "doc_id", "tag", "at")
        open_rows = marked.filter((F.coalesce("n", F.lit(1)) == 1) | me.eqNullSafe(F.col("one")))
        open_rows = open_rows.withColumn("left_behind", F.col("left_behind") | (F.coalesce("n", F.lit(1)) > 1)).drop("n", "one", "whole")
        cores = open_rows.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("left_behind")).alias("asking"))
        cores = cores.filter("n > 1 and asking > 0").select(_other("core").alias("group"), "n", "asking")
        open_rows = open_rows.join(cores, _other("core") == F.col("group"))
        open_rows = land(open_rows.drop("group", "asking"))
        small = open_rows.filter(F.col("n") <= group_rows).withColumn("key", F.col("core")).drop("n", "core")
        groups = small if groups is None else groups.unionByName(small)
        large = open_rows.filter((F.col("n") > group_rows) & (F.col("low") < F.col("high")))
        if large.isEmpty():
            return settled, groups
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
        names = [name for name in anchors.columns if name not in ("low", "high")]
        active = large.select(*names, F.explode(halves).alias("half")).select(*names, "half.low", "half.high").select(anchors.columns)


# --- the operator


def _merge(spans: list[dict]) -> list[int]:
    merged: list[int] = []
    for span in sorted(spans, key=lambda span: (span["start"], span["end"])):
        if merged and span["start"] <= merged[-1]:
            merged[-1] = max(merged[-1], span["end"])
        else:
            merged += [span["start"], span["end"]]
    return merged


def cut(text: bytes, spans: list[int]) -> bytes:
    """``text`` without the bytes in ``spans``: start, end, start, end, ..."""
    edges = [0, *spans, len(text)]
    return b"".join(text[begin:end] for begin, end in zip(edges[::2], edges[1::2]))


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_merge(found) for found in batch.column("found").to_pylist()]
        kept = [hashlib.sha256(cut(text.as_py(), merged)).hexdigest() for text, merged in zip(batch.column("text"), spans)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string())], ["doc_id", "tag", "spans", "kept_sha256"])


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH, gram: int = GRAM, group_rows: int = 20_000
) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, n_bytes, spans, kept_sha256.

    ``spans`` has the bytes of the text (UTF-8) that lie in a string of ``match``
    bytes which also starts at another place of any text, as start, end, start,
    end, ...; ``kept_sha256`` is the digest of the other bytes, see ``cut``.
    Null and empty texts have none.  Rows equal in id and text are
    two texts, which repeat each other.  Other columns are not looked at.  An
    empty table gives an empty result.
    """
    if not 0 < gram <= match:
        raise ValueError(f"a gram has 1 to {match} bytes, not {gram}")
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text).select(
        "doc_id", text_tag(F.col("text")).alias("tag"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    anchors = land(rows.mapInArrow(_anchor_rows(match, gram), f"doc_id {kind}, tag long, gram long, at long"))
    counts = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Joined on another form of the key, both sides are shuffled, and Spark splits the tasks of common grams.
    counts = counts.select(F.bitwise_not("gram").alias("other"), "n")
    met = anchors.join(counts, F.bitwise_not("gram") == F.col("other")).select("doc_id", "tag", F.struct("at", "gram", (F.col("n") > group_rows).alias("hot")).alias("anchor"))
    per_text = met.groupBy(F.col("doc_id").alias("other_id"), F.col("tag").alias("other_tag")).agg(F.collect_set("anchor").alias("anchors"))
    mine = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("tag") == F.col("other_tag"))
    path = scratch(spark, "candidates")
    rows.join(per_text, mine).select("doc_id", "tag", "text", "anchors").write.parquet(path)
    candidates = spark.read.parquet(path)

    arrow_id = to_arrow_type(rows.schema["doc_id"].dataType)
    context = pa.schema([("gram", pa.int64()), ("doc_id", arrow_id), ("tag", pa.int64()), ("at", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
    span = pa.schema([("doc_id", arrow_id), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    shape = f"gram long, doc_id {kind}, tag long, at long, before binary, after binary"
    bounds = {"low": F.lit(0), "high": F.lit(match - gram), "left_behind": F.lit(False)}
    groups = candidates.mapInArrow(_contexts(match, gram, context, False), shape).withColumns(bounds)
    groups = groups.withColumn("key", F.col("gram").cast("string").cast("binary"))
    settled = None
    if not candidates.filter(F.exists("anchors", lambda anchor: anchor["hot"])).isEmpty():
        hot = candidates.mapInArrow(_contexts(match, gram, context, True), shape).withColumns(bounds)
        settled, rest = _halved(hot, match, group_rows)
        groups = groups.unionByName(rest)
    found = groups.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(match, span), f"doc_id {kind}, tag long, start long, end long")
    if settled is not None:
        found = found.unionByName(settled)
    found = found.groupBy(F.col("doc_id").alias("other_id"), F.col("tag").alias("other_tag")).agg(F.collect_set(F.struct("start", "end")).alias("found"))
    cut_texts = candidates.dropDuplicates(["doc_id", "tag"]).join(found, mine).select("doc_id", "tag", "text", "found")
    answers = cut_texts.mapInArrow(_finish, f"doc_id {kind}, tag long, spans array<bigint>, kept_sha256 string")
    answers = answers.withColumnsRenamed({"doc_id": "other_id", "tag": "other_tag", "kept_sha256": "cut_sha256"})
    facts = rows.select("doc_id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
    return facts.join(answers, mine, "left").select(
        "doc_id", "tag", "n_bytes", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256")
    )
