"""Centroid clustering against plain rounds in whole numbers."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brooklet.llm.subvectors import centroid_digest, cluster_vectors


def plain_clusters(rows, size, clusters, rounds, scale=64):
    """(id, cluster, distance, centroid) of rows (id, vector)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    draw = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((draw(i), v) for i, v in kept)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), number) for number, c in enumerate(centroids))

    for _ in range(rounds):
        given = [nearest(v)[1] for _, v in kept]
        for number in set(given):
            own = [v for (_, v), cluster in zip(kept, given) if cluster == number]
            centroids[number] = [sum(xs) // len(own) for xs in zip(*own)]
    return [(i, *reversed(nearest(v)), centroids[nearest(v)[1]]) for i, v in kept]


def check(spark, rows, size=8, clusters=4, rounds=3, **settings):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    table = table.select("*", F.lit("clash").alias("cluster"), F.lit(1).alias("EMBEDDING"), F.lit(0).alias("row"))
    found = cluster_vectors(table, size=size, clusters=clusters, rounds=rounds, **settings).withColumn("digest", centroid_digest(F.col("centroid"))).collect()
    wanted = plain_clusters(rows, size, clusters, rounds)
    assert sorted(str((r["vec_id"], r["cluster"], r["distance"], r["centroid"])) for r in found) == sorted(map(str, wanted))
    sums = Counter()
    for _, cluster, distance, _ in wanted:
        sums[cluster] += distance
    for row in found:
        assert row["cluster_inertia"] == sums[row["cluster"]] and row["inertia"] == sum(sums.values())
        assert row["digest"] == hashlib.sha256(",".join(map(str, row["centroid"])).encode()).hexdigest()
    return found


def vectors(n, size=8, seed=1, spread=1.0):
    draw = random.Random(seed)
    return [(number, [draw.gauss((number % 5) / 3, spread) for _ in range(size)]) for number in range(n)]


@pytest.mark.parametrize("settings", [{}, {"width": 1}, {"width": 4}, {"table_bytes": 0}, {"table_bytes": 0, "width": 4}])
def test_rounds(spark, settings):
    check(spark, vectors(300), **settings)


@pytest.mark.parametrize("table_bytes", [1 << 20, 0])
def test_edges(spark, table_bytes):
    """Bad vectors are left out; repeated rows, equal and null ids count; a hot vector is a third of all."""
    inf, nan = float("inf"), float("nan")
    rows = vectors(40) + [(50, None), (51, []), (52, [1.0] * 7), (53, [1.0] * 9), (54, [inf] + [0.0] * 7), (55, [0.0] * 7 + [nan]), (56, [None] + [1.0] * 7)]
    rows += [(None, [0.5] * 8), (None, [0.25] * 8), (7, [0.1] * 8), (7, [0.1] * 8), (60, [-0.0] * 8), (61, [-1e-300] * 8)] + [(70, [1.0] * 8)] * 25
    check(spark, rows, clusters=16, table_bytes=table_bytes)


@pytest.mark.parametrize("rows", [[(1, [0.3] * 8)], vectors(3), [(1, [0.5] * 8), (2, [0.5] * 8), (3, [0.5] * 8)]])
def test_few_vectors(spark, rows):
    check(spark, rows, clusters=16)


def test_empty(spark):
    for rows in ([], [(1, None)]):
        assert cluster_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect() == []


def test_ties_go_to_the_smaller_number(spark):
    check(spark, [(number, [float(number % 2)] + [0.0] * 7) for number in range(30)] + [(99, [0.5] + [0.0] * 7)], clusters=2, rounds=0)


def test_large_components(spark):
    """Exact up to the limit, refused beyond it."""
    edge = (2**27 - 1) / 64
    rows = [(number, [edge if (number >> bit) & 1 else -edge for bit in range(8)]) for number in range(64)]
    check(spark, rows, clusters=3)
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * 8)], "vec_id bigint, embedding array<double>"), size=8).collect()
