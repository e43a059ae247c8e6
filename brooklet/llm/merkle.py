"""A Merkle manifest of a dataset: digests of all records, a tree per group, a tree over the groups, and proofs.

The nodes of a level stand in order; every ``fanout`` neighbours are pivoted
into one row, a column per slot (conditional aggregates).  The hash of the
concatenated columns is the parent; the columns beside a child's own slot are
its siblings.  Trees are built upwards level by level, each level a table with
a ``fanout``-th of the rows below; proofs are handed downwards, so that a
leaf's whole proof exists only in the row that returns it and is never moved.

Positions come from ranges over (group, order): a group with a third of all
rows is spread over many tasks, and what joins ranges are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brooklet.llm.common import land, partitions
from brooklet.operators.hotkeys import in_ranges

FANOUT = 16


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenated texts."""
    return F.sha2(F.concat_ws("", *parts), 256)


def record_digest(*values: Column) -> Column:
    """Digest of a record: each value as its byte count, ``:`` and its text in UTF-8; ``-`` where it is null."""
    return digest(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from ``leaf`` and the siblings in ``path``."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of a proof: the siblings' digests, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with each one's place in its group (``pos``, from 0) and the group's size (``n``)."""
    blocks = in_ranges(rows, partitions(rows.sparkSession), "grp", *order)
    here = blocks.groupBy("block", "grp").agg(F.count(F.lit(1)).alias("here"))
    group = Window.partitionBy("grp")  # a row per range that the group reaches into
    before = F.sum("here").over(group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = here.select("block", "grp", F.coalesce(before, F.lit(0)).alias("start"), F.sum("here").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy("block", "grp").orderBy(*order)) - 1
    placed = blocks.withColumn("inside", inside).join(starts, ["block", "grp"])
    return placed.withColumn("pos", F.col("start") + F.col("inside")).drop("block", "start", "inside")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """A row per run of ``fanout`` neighbours of ``nodes`` (grp, pos, n, node), with a column per slot and the run's digest."""
    slot = F.col("pos") % fanout
    slots = [F.first(F.when(slot == place, F.col("node")), ignorenulls=True).alias(f"slot{place}") for place in range(fanout)]
    above = [F.expr(f"pos div {fanout}").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")]
    runs = nodes.filter("n > 1").groupBy("grp", *above).agg(*slots)
    return land(runs.withColumn("digest", digest(*[F.col(f"slot{place}.digest") for place in range(fanout)])))


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels above ``nodes``, from the lowest; a group ends on the level where it has one node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while most > 1:
        below = levels[-1].select("grp", "pos", "n", F.struct("digest").alias("node")) if levels else nodes
        levels.append(_parents(below, fanout))
        most = -(-most // fanout)
    return levels


def _children(runs: DataFrame, fanout: int, carried: list[str]) -> DataFrame:
    """The children of ``runs``, each with its step (siblings on both sides) before its parent's ``path``."""
    digests = [F.col(f"slot{place}.digest") for place in range(fanout)]
    children = [
        F.struct(
            (F.col("pos") * fanout + place).alias("pos"), F.col(f"slot{place}").alias("node"),
            F.concat_ws("", *digests[:place]).alias("left"), F.concat_ws("", *digests[place + 1 :]).alias("right"),
        )
        for place in range(fanout)
    ]
    rows = runs.select("grp", "path", *carried, F.explode(F.array(*children)).alias("child")).filter("child.node is not null")
    step = F.struct("child.left", "child.right")
    return rows.select("grp", "child.pos", "child.node", F.concat(F.array(step), F.col("path")).alias("path"), *carried)


def _descend(nodes: DataFrame, levels: list[DataFrame], heads: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with their paths; ``heads`` (grp, path and what is handed on) has what lies above each group."""
    carried = [name for name in heads.columns if name not in ("grp", "path")]
    alone = nodes.filter("n = 1").join(heads, "grp").select("grp", "pos", "node", "path", *carried)
    below = None
    for number, level in reversed(list(enumerate(levels))):
        placed = level.filter("n = 1").join(heads, "grp")
        if below is not None:
            placed = placed.unionByName(level.join(below.drop("node"), ["grp", "pos"]))
        below = _children(placed, fanout, carried)
        if number:  # the lowest level is not kept: its rows hold whole proofs
            below = land(below)
    return alone if below is None else below.unionByName(alone)


def merkle_proofs(rows: DataFrame, group: str, order: str, leaf: str, carry: list[str] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``rows``: the columns ``carry``, leaf, subroot, root and ``path``.

    Per ``group`` (its text; null is a group, the first one) the leaves ascend
    by ``order`` (null first), then by digest; while more than one node
    remains, every ``fanout`` neighbours become the digest of their
    concatenation (the last run may have fewer, even one).  The groups' roots,
    in bytewise order of the groups, give the root in the same way; a lone node
    is its own root.  ``path`` is a list of (left, right): the digests of the
    siblings on both sides, from the leaf's level to the root's.  Rows equal
    in group, order and leaf stand side by side and share the leaf, so their
    order changes nothing but which of them has which place.  ``leaf`` must not
    be null.  An empty table gives an empty result.
    """
    carry = carry or []
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    numbered = rows.toDF(*[f"_{place}" for place in range(len(rows.columns))])
    column = {name: F.col(f"_{place}") for place, name in enumerate(rows.columns)}
    name = column[group].cast("string")
    carried = F.struct(column[leaf].alias("digest"), *[column[item].alias(f"c{place}") for place, item in enumerate(carry)])
    leaves = numbered.select(
        F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name)).alias("grp"),  # never null, null first
        column[order].alias("ord"), column[leaf].alias("leaf"), F.monotonically_increasing_id().alias("row"), carried.alias("node"),
    )
    nodes = land(_positions(land(leaves), "ord", "leaf", "row").select("grp", "pos", "n", "node"))
    levels = _levels(nodes, fanout)
    subroots = nodes.filter("n = 1").select("grp", F.col("node.digest").alias("digest"))
    for level in levels:
        subroots = subroots.unionByName(level.filter("n = 1").select("grp", "digest"))
    members = land(subroots).select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.struct("digest", F.col("grp").alias("member")).alias("node"))
    tops = land(_positions(members, "member").select("grp", "pos", "n", "node"))
    above = _levels(tops, fanout)
    last = above[-1].filter("n = 1").select("grp", "digest") if above else tops.select("grp", F.col("node.digest").alias("digest"))
    steps = "array<struct<left:string,right:string>>"
    roots = last.select("grp", F.array().cast(steps).alias("path"), F.col("digest").alias("root"))
    heads = _descend(tops, above, roots, fanout)
    heads = land(heads.select(F.col("node.member").alias("grp"), "path", "root", F.col("node.digest").alias("subroot")))
    found = _descend(nodes, levels, heads, fanout)
    named = [F.col(f"node.c{place}").alias(item) for place, item in enumerate(carry)]
    return found.select(*named, F.col("node.digest").alias("leaf"), "subroot", "root", "path")
