"""Centroid clustering (Lloyd's rounds) on whole-number vectors with exact arithmetic, by subvector dictionaries.

The dimensions are cut into blocks.  All distinct subvectors of a block form
its dictionary, and a vector is kept as one code per block: nothing is lost.
Once per round the squared distance of every dictionary entry to every
centroid's part is computed; a vector's distance to a centroid is the sum of
its codes' entries.  New centroids are exact sums of decoded vectors.

A dictionary whose distances take at most ``table_bytes`` is sent to all tasks,
which look codes up.  A larger one stays a table: vectors' codes are joined
with it, the distances added per vector, and new centroids computed from counts
per (cluster, code).  Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import land, pick, ranked

# Components beyond this could leave 64 bits in a squared distance of MAX_SIZE dimensions.
LIMIT = 1 << 27
MAX_SIZE = 128
TABLE_BYTES = 64 << 20
# Vectors of a batch that are decoded and measured at once.
ROWS = 4096


@dataclass(frozen=True)
class Dictionary:
    """Distinct subvectors of all blocks; an entry's code is its place, blocks one after the other, sorted within."""

    starts: np.ndarray  # of the blocks, and the end
    entries: np.ndarray  # (codes, width)
    values: list[list[np.ndarray]]  # per block and dimension: the sorted distinct components
    keys: list[np.ndarray]  # per block: its entries as one ascending number each

    @staticmethod
    def build(blocks: np.ndarray, entries: np.ndarray, count: int) -> Dictionary | None:
        """From the distinct (block, subvector) in any order; None where a block's keys would leave 64 bits."""
        order = np.lexsort([*entries.T[::-1], blocks])
        blocks, entries = blocks[order], entries[order]
        starts = np.searchsorted(blocks, np.arange(count + 1))
        values, keys = [], []
        for begin, end in zip(starts[:-1], starts[1:]):
            own = [np.unique(entries[begin:end, place]) for place in range(entries.shape[1])]
            if float(np.prod([float(len(found)) for found in own])) >= 2.0**62:
                return None
            values.append(own)
            keys.append(_key(own, entries[begin:end]))
        return Dictionary(starts, entries, values, keys)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """The codes of ``vectors`` (rows, dimensions), all of whose subvectors are known."""
        width = self.entries.shape[1]
        parts = [
            begin + np.searchsorted(keys, _key(values, vectors[:, block * width : (block + 1) * width]))
            for block, (begin, values, keys) in enumerate(zip(self.starts, self.values, self.keys))
        ]
        return np.stack(parts, axis=1).astype(np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.entries[codes].reshape(len(codes), -1)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every entry to its block's part of every centroid: (codes, centroids)."""
        width = self.entries.shape[1]
        table = np.empty((len(self.entries), len(centroids)), dtype=np.int64)
        for block, (begin, end) in enumerate(zip(self.starts[:-1], self.starts[1:])):
            part = centroids[:, block * width : (block + 1) * width]
            table[begin:end] = ((self.entries[begin:end, None, :] - part[None, :, :]) ** 2).sum(axis=2)
        return table


def _key(values: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Rows as numbers that ascend as the rows do, in the mixed radix of ``values``."""
    key = np.zeros(len(rows), dtype=np.int64)
    for place, known in enumerate(values):
        key = key * len(known) + np.searchsorted(known, rows[:, place])
    return key


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A list column whose lists have one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as double; a component beyond the limit of exact distances fails the query."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    bad = F.raise_error(F.lit(f"a scaled component is beyond {LIMIT}"))
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < LIMIT, whole(x)).otherwise(bad.cast("bigint")))


def sound(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def _distinct_parts(width: int):
    """Distinct (dims: the block's number, subvector) of a batch, so that few rows are left to group."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"))
            if not len(vectors):
                continue
            for block in range(vectors.shape[1] // width):
                parts = np.unique(vectors[:, block * width : (block + 1) * width], axis=0)
                yield pa.record_batch([pa.array(np.full(len(parts), block, dtype=np.int32)), _lists(parts)], ["dims", "part"])

    return emit


def _encoded(shared):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = _lists(shared.value.encode(_matrix(batch.column("vec"))))
                yield pa.record_batch([batch.column("vec_id"), codes], ["vec_id", "codes"])

    return emit


def _nearest(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals) and squared distance of encoded vectors."""
    total = table[codes[:, 0]]
    for block in range(1, codes.shape[1]):
        total += table[codes[:, block]]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(codes)), cluster]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, len(batch), ROWS):
            piece = batch.slice(begin, ROWS)
            yield piece, _matrix(piece.column("codes"), np.int32)


def _sums(dictionary, table):
    """Per task: how many vectors each cluster gets, and the sums of their components."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sums = None
        for _, codes in _pieces(batches):
            cluster, _ = _nearest(codes, table.value)
            vectors = dictionary.value.decode(codes)
            if n is None:
                n, sums = np.zeros(table.value.shape[1], dtype=np.int64), np.zeros((table.value.shape[1], vectors.shape[1]), dtype=np.int64)
            n += np.bincount(cluster, minlength=len(n))
            order = np.argsort(cluster, kind="stable")
            found, begins = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(vectors[order], begins, axis=0)
        if n is not None:
            yield pa.record_batch([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), _lists(sums)], ["cluster", "n", "sums"])

    return emit


def _assigned(table):
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, codes in _pieces(batches):
            cluster, distance = _nearest(codes, table.value)
            yield pa.record_batch([piece.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return emit


class _Lookup:
    """Rounds with a dictionary that every task holds."""

    def __init__(self, vectors: DataFrame, dictionary: Dictionary):
        self.context = vectors.sparkSession.sparkContext
        self.dictionary = dictionary
        self.shared = self.context.broadcast(dictionary)
        self.kind = vectors.schema["vec_id"].dataType.simpleString()
        self.codes = land(vectors.mapInArrow(_encoded(self.shared), f"vec_id {self.kind}, codes array<int>"))

    def sums(self, centroids: np.ndarray) -> DataFrame:
        table = self.context.broadcast(self.dictionary.distances(centroids))
        return self.codes.select("codes").mapInArrow(_sums(self.shared, table), "cluster int, n long, sums array<long>")

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        table = self.context.broadcast(self.dictionary.distances(centroids))
        return self.codes.mapInArrow(_assigned(table), f"vec_id {self.kind}, cluster int, distance long")


class _Joined:
    """Rounds with a dictionary that stays a table, however large."""

    def __init__(self, vectors: DataFrame, parts: DataFrame, width: int, size: int):
        self.width = width
        self.entries = land(ranked(parts, "code", F.col("dims"), F.col("part")).select("code", "dims", "part"))
        rows = land(vectors.withColumn("row", F.monotonically_increasing_id()))
        self.ids = rows.select("row", "vec_id")
        blocks = [F.struct(F.lit(block).alias("dims"), F.slice("vec", block * width + 1, width).alias("part")) for block in range(size // width)]
        pieces = rows.select("row", F.explode(F.array(*blocks)).alias("piece")).select("row", "piece.dims", "piece.part")
        self.codes = land(pieces.join(self.entries, ["dims", "part"]).select("row", "code"))

    def _measured(self, centroids: np.ndarray) -> DataFrame:
        """(row, cluster, distance): partial distances of the dictionary's entries, added by code."""
        width = self.width
        own = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in c[b : b + width]]) for c in centroids]) for b in range(0, centroids.shape[1], width)])
        square = lambda a, b: (a - b) * (a - b)
        to = lambda c: F.aggregate(F.zip_with(F.col("part"), c, square), F.lit(0).cast("long"), lambda x, y: x + y)
        table = self.entries.select("code", F.transform(F.get(own, F.col("dims")), to).alias("far"))
        added = self.codes.join(table, "code").groupBy("row").agg(*[F.sum(F.get("far", F.lit(c))).alias(f"d{c}") for c in range(len(centroids))])
        best = F.array_min(F.array(*[F.struct(F.col(f"d{c}").alias("distance"), F.lit(c).alias("cluster")) for c in range(len(centroids))]))
        return added.select("row", best.alias("best")).select("row", "best.cluster", "best.distance")

    def sums(self, centroids: np.ndarray) -> DataFrame:
        counts = self.codes.join(self._measured(centroids), "row").groupBy("cluster", "code").agg(F.count(F.lit(1)).alias("times"))
        blocks = self.entries.join(counts, "code").select(
            "cluster", "dims", "times", F.transform("part", lambda x: x.cast("decimal(20,0)") * F.col("times")).alias("scaled")
        )
        parts = [F.sum(F.get("scaled", F.lit(place))).alias(f"s{place}") for place in range(self.width)]
        each = blocks.groupBy("cluster", "dims").agg(F.sum("times").alias("n"), *parts)
        ordered = F.array_sort(F.collect_list(F.struct("dims", F.array(*[F.col(f"s{place}") for place in range(self.width)]).alias("s"))))
        return each.groupBy("cluster").agg(F.max("n").alias("n"), F.flatten(F.transform(ordered, lambda x: x["s"])).alias("sums"))

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        return self._measured(centroids).join(self.ids, "row").select("vec_id", "cluster", "distance")


def _moved(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of each component, in whole numbers of any size."""
    each = sums.select("cluster", "n", F.posexplode("sums").alias("place", "value"))
    exact = F.sum(F.col("value").cast("decimal(28,0)")).alias("value")
    found = centroids.copy()
    for row in each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), exact).collect():  # a row per centroid and dimension
        if row["n"]:
            found[row["cluster"], row["place"]] = int(row["value"]) // row["n"]
    return found


def cluster_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    size: int = 64,
    scale: int = 64,
    clusters: int = 16,
    rounds: int = 3,
    seed: str = "1:",
    width: int = 2,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row per sound vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid.

    Sound vectors have ``size`` components, none null, NaN or infinite; others
    are left out.  Components count as floor(scale * x).  The centroids start
    as the ``clusters`` vectors with the smallest SHA-256 of ``seed`` + id (a
    null id counts as empty text; equal ids stand by their components); fewer
    vectors give fewer centroids.  Each round gives every vector to its nearest
    centroid (ties: the smaller number) and moves every centroid that has
    vectors to floor(sum / count) of each component; then vectors are given out
    once more.  ``cluster_inertia`` and ``inertia`` are the distances summed
    over the cluster and over all; ``centroid`` is a list of the final
    centroid's components.  Repeated rows count one by one.  A scaled component
    beyond 2^27 fails the query.  An empty table gives an empty result.

    ``width`` is the number of dimensions of a block and must divide ``size``;
    dictionaries above ``table_bytes`` are joined instead of sent.
    """
    if size % width or not 0 < size <= MAX_SIZE:
        raise ValueError(f"size must be 1 to {MAX_SIZE} and a multiple of width")
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=vec_id, vec=vector).filter(sound(F.col("vec"), size))
    rows = rows.withColumn("vec", whole_components(F.col("vec"), scale))
    kind = rows.schema["vec_id"].dataType.simpleString()
    draw = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(draw.alias("draw"), "vec").orderBy("draw", "vec").limit(clusters).collect()  # a row per centroid
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([row["vec"] for row in first], dtype=np.int64)
    parts = land(rows.select("vec").mapInArrow(_distinct_parts(width), "dims int, part array<long>").distinct())
    entries, dictionary = parts.count(), None
    if entries * 8 * max(len(first), 2 * width) <= table_bytes:
        taken = parts.toArrow()  # bounded by table_bytes
        blocks = taken.column("dims").combine_chunks().to_numpy(zero_copy_only=False)
        dictionary = Dictionary.build(blocks, _matrix(taken.column("part").combine_chunks()), size // width)
    way = _Joined(rows, parts, width, size) if dictionary is None else _Lookup(rows, dictionary)
    for _ in range(rounds):
        centroids = _moved(way.sums(centroids), centroids)
    given = land(way.assigned(centroids))
    sums = {row["cluster"]: int(row["d"]) for row in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    facts = [(number, own, sum(sums.values()), centroids[number].tolist()) for number, own in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return given.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """SHA-256 of the components as decimal numbers, joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
