"""Manifests against plain trees."""

import hashlib
from collections import defaultdict

import pytest
from corpora import edge_rows, table
from pyspark.sql import functions as F

from brooklet.llm.merkle import fold, merkle_proofs, path_digest, record_digest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_record(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves, fanout):
    """Root and, for each leaf, its siblings as (left, right) per level."""
    paths, nodes, members = [[] for _ in leaves], list(leaves), [[place] for place in range(len(leaves))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), fanout)
        for begin in runs:
            run = nodes[begin : begin + fanout]
            for slot in range(len(run)):
                for leaf in members[begin + slot]:
                    paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        members = [sum(members[begin : begin + fanout], []) for begin in runs]
        nodes = [sha(*nodes[begin : begin + fanout]) for begin in runs]
    return nodes[0], paths


def plain_proofs(rows, fanout):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, leaf)."""
    groups = defaultdict(list)
    for doc_id, source, leaf in rows:
        groups[source].append((doc_id, leaf))
    order = sorted(groups, key=lambda source: (source is not None, (source or "").encode()))
    trees, sorted_leaves = {}, {}
    for source in order:
        sorted_leaves[source] = sorted(groups[source], key=lambda row: (row[0] is not None, row[0] or 0, row[1]))
        trees[source] = plain_tree([leaf for _, leaf in sorted_leaves[source]], fanout)
    if not order:
        return []
    root, tops = plain_tree([trees[source][0] for source in order], fanout)
    found = []
    for source, top in zip(order, tops):
        subroot, paths = trees[source]
        found += [(doc_id, leaf, subroot, root, path + top) for (doc_id, leaf), path in zip(sorted_leaves[source], paths)]
    return found


def found(spark, rows, fanout):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, leaf string").withColumn("root", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("GRP", F.lit(2))
    proofs = merkle_proofs(docs, "source", "doc_id", "leaf", carry=["doc_id"], fanout=fanout)
    proofs = proofs.withColumn("folded", fold(F.col("leaf"), F.col("path"))).withColumn("proof", path_digest(F.col("path")))
    for row in (taken := proofs.collect()):
        assert row["folded"] == row["root"]
        assert row["proof"] == sha(*[side for step in row["path"] for side in step])
    return sorted(str((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(step) for step in r["path"]])) for r in taken)


def expected(rows, fanout):
    return sorted(map(str, plain_proofs(rows, fanout)))


@pytest.mark.parametrize("fanout", [16, 2, 3])
def test_trees_of_many_heights(spark, fanout):
    sizes = {"hot": 300, None: 17, "": 16, "é": 1, "Z": 33, "a": 2}
    rows, number = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            number += 1
            rows.append((number * 7919 % 1009, source, sha(str(number))))
    assert found(spark, rows, fanout) == expected(rows, fanout)


def test_many_groups(spark):
    rows = [(number, f"s{number % 40}", sha(str(number))) for number in range(70)]
    assert found(spark, rows, 3) == expected(rows, 3)


@pytest.mark.parametrize("rows", [[], [(1, "a", sha("x"))], [(None, None, sha("x"))], [(1, "a", sha("x")), (2, None, sha("y"))]])
def test_small_tables(spark, rows):
    assert found(spark, rows, 16) == expected(rows, 16)


def test_ties_and_repeated_rows(spark):
    """Equal ids stand by digest; equal rows share digest, subroot and root."""
    rows = [(4, "a", sha("x")), (4, "a", sha("y")), (None, "a", sha("n")), (None, "a", sha("m"))] + [(7, "a", sha("same"))] * 60
    assert found(spark, rows, 4) == expected(rows, 4)


def test_records(spark):
    docs = table(spark, edge_rows())
    text = docs.toDF(*[f"c{place}" for place in range(len(docs.columns))])
    taken = text.select(record_digest(*[F.col(f"c{place}") for place in (0, 3, 2, 4, 1)]).alias("leaf")).collect()
    assert [row["leaf"] for row in taken] == [plain_record(row[0], (*row, None)[3] if len(row) > 3 else None, row[2] if len(row) > 2 else None, None, row[1]) for row in edge_rows()]


def test_a_changed_record_is_found(spark):
    rows = [(number, f"s{number % 3}", sha(str(number))) for number in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, leaf string")
    docs = docs.withColumn("claim", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("leaf")))
    proofs = merkle_proofs(docs, "source", "doc_id", "leaf", carry=["doc_id", "claim"], fanout=4)
    for row in proofs.withColumn("sound", fold(F.col("claim"), F.col("path")) == F.col("root")).collect():
        assert row["sound"] == (row["doc_id"] % 7 != 0)
