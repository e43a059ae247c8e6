"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with ``target / source size`` = 1.7 should be taken 1.7
times: once for sure, and a second time with probability 0.7.  The fractional
parts are settled in pairs.  The mass of a document is its words times its
probability; between two documents mass moves in a random direction until the
probability of one of them is 0 or 1, with chances that leave every expectation
as it was.  The sum of the masses never changes, so the words taken from a
source miss its target by less than one document.

The pairs form a tree: documents are dealt into buckets by a hash, a bucket is
settled but for one document, the left-over documents of ``bucket`` neighbouring
buckets meet in the next round, until one document per source is left.
All draws are hashes of the documents, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.llm.common import WORD, land, partitions, pick, ranked, text_tag


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with place and target.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``cap`` times the source's size and what is
    above is shared again by weight among the others.  The loop reads one small
    row per round: the words already at their limit, and the free weights.
    """
    placed = ranked(sizes, "place", F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = land(placed.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(cap)))
    all_words, all_weights = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (all_words or 0) / (all_weights or 1), 0
    while True:
        at_limit = F.col("limit") < F.col("weight") * F.lit(level)
        n, words, free = placed.agg(
            F.count_if(at_limit), F.sum(F.when(at_limit, F.col("source_size"))), F.sum(F.when(~at_limit, F.col("weight")))
        ).first()
        if n == full or not free:
            break
        full, level = n, (all_words - cap * words) / free
    target = F.least(F.col("limit"), F.col("weight") * F.lit(level))
    return placed.select("source", "source_size", "place", target.alias("target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _numbered(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with ``nth``, which tells rows equal in everything else apart, whatever the partitions.

    Equal rows are counted, map-side first, and dealt out again.  More than
    ``block`` of them are cut into blocks, which go to different tasks.
    """
    counted = land(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))

    def dealt(some: DataFrame, first: Column, last: Column) -> DataFrame:
        return some.select(*rows.columns, F.explode(F.sequence(first, last)).alias("nth"))

    few = dealt(counted.filter(F.col("n") <= block), F.lit(0).cast("long"), F.col("n") - 1)
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))).alias("begin")
    many = counted.filter(F.col("n") > block).select("*", begins).repartition(partitions(rows.sparkSession), *rows.columns, "begin")
    return few.unionByName(dealt(many, F.col("begin"), F.least(F.col("begin") + (block - 1), F.col("n") - 1)))


def _settle(items: Column, item: T.StructType, seed: int, level: int) -> Column:
    """Pair the items one after another: ``open`` is the one left over, ``done`` the settled ones with their ``bit``."""
    settled = T.ArrayType(T.StructType([*item.fields, T.StructField("bit", T.IntegerType())]))

    def with_mass(one: Column, mass: Column) -> Column:
        return F.struct(*[(mass if f.name == "mass" else one[f.name]).alias(f.name) for f in item.fields])

    def with_bit(one: Column, bit: Column) -> Column:
        return F.struct(*[one[f.name].alias(f.name) for f in item.fields], bit.alias("bit"))

    def step(state: Column, new: Column) -> Column:
        old, done = state["open"], state["done"]
        room, space = old["size"] - old["mass"], new["size"] - new["mass"]
        up, down = F.least(room, new["mass"]), F.least(old["mass"], space)
        to_old = _draw(F.lit(seed), F.lit(level), old["order"], new["order"]) * (up + down) < down
        old_done = F.when(to_old, room <= new["mass"]).otherwise(old["mass"] <= space)
        bit = (to_old == old_done).cast("int")  # the settled one got all of itself, or lost everything
        moved = F.when(to_old, up).otherwise(-down)
        left = F.when(old_done, with_mass(new, new["mass"] - moved)).otherwise(with_mass(old, old["mass"] + moved))
        gone = F.when(old_done, with_bit(old, bit)).otherwise(with_bit(new, bit))
        return F.when(old.isNull(), F.struct(new.alias("open"), done.alias("done"))).otherwise(
            F.struct(left.alias("open"), F.concat(done, F.array(gone)).alias("done"))
        )

    nothing = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(settled).alias("done"))
    return F.aggregate(F.sort_array(items), nothing, step)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: int = 0,
    bucket: int = 64,
    salts: int = 32,
    block: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, source, size, source_size, target, copies, taken.

    ``size`` counts the words of the text (null: 0), ``copies`` says how often
    the mix takes the document, ``taken`` is copies x size.  A document without
    words has 0 copies.  Null is a source of its own, the last one.  Rows equal
    in id and text are separate documents with the same chances, numbered so
    that they spread over buckets and tasks (``block`` of them stay together).  Other columns
    are not looked at.  An empty table gives an empty result.
    """
    rows = pick(docs, doc_id=doc_id, source=source, text=text)
    rows = rows.select(
        "doc_id",
        "source",
        text_tag(F.col("text")).alias("tag"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = _numbered(rows, block)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, cap).withColumnRenamed("source", "name")
    counts = sizes.select("source", F.ceil(F.col("n") / bucket).alias("buckets"))
    targets = land(targets.join(counts, F.col("name").eqNullSafe(F.col("source"))).drop("source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.least(F.floor(ratio), F.lit(math.ceil(cap) - 1))
    targets = targets.select("*", sure.cast("int").alias("sure"), (ratio - sure).alias("chance"))
    # A source with a third of all rows is spread over ``salts`` keys of the join.
    dealt = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "tag", "nth"))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64(F.lit(seed), "tag", "doc_id", "nth", F.lit("lane")), F.lit(salts)).cast("int"))
    rows = rows.join(dealt, F.col("source").eqNullSafe(F.col("name")) & (F.col("lane") == F.col("salt")))
    facts = ["source_size", "target", "sure"]
    final = ["doc_id", "tag", "source", "size", *facts]
    empty = rows.filter("size = 0").select(*final, F.lit(0).alias("copies"))

    item = F.struct(
        (-F.col("size")).alias("large_first"), "order", "doc_id", "tag", F.col("size").cast("double").alias("size"),
        (F.col("size") * F.col("chance")).alias("mass"),
    ).alias("item")
    # The order of the fields is the order of the pairs, large documents first.  The one left over may be large all the same,
    # so a source misses its target by up to its largest document.
    number = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tag", "nth", F.lit("bucket")), F.col("buckets")).alias("bucket")
    waiting = rows.filter("size > 0").select("place", number, item, "source", *facts)
    kind = waiting.schema["item"].dataType
    widest = targets.agg(F.max("buckets")).first()[0] or 1
    results, level = [empty], 0
    while True:
        constant = [F.first(name).alias(name) for name in ("source", *facts)]
        paired = waiting.groupBy("place", "bucket").agg(F.collect_list("item").alias("items"), *constant)
        paired = land(paired.withColumn("state", _settle(F.col("items"), kind, seed, level)).drop("items"))
        one = paired.select("source", *facts, F.explode("state.done").alias("one"))
        copies = F.col("sure") + F.col("one.bit")
        results.append(one.select("one.doc_id", "one.tag", "source", F.col("one.size").cast("long").alias("size"), *facts, copies.alias("copies")))
        if widest <= 1:
            break
        waiting = paired.select("place", F.floor(F.col("bucket") / bucket).alias("bucket"), F.col("state.open").alias("item"), "source", *facts)
        widest, level = math.ceil(widest / bucket), level + 1
    last = paired.select("source", *facts, F.col("state.open").alias("one"))
    bit = (_draw(F.lit(seed), F.lit("last"), F.col("one.order")) * F.col("one.size") < F.col("one.mass")).cast("int")
    results.append(last.select("one.doc_id", "one.tag", "source", F.col("one.size").cast("long").alias("size"), *facts, (F.col("sure") + bit).alias("copies")))
    mixed = results[0]
    for part in results[1:]:
        mixed = mixed.unionByName(part)
    return mixed.select(
        "doc_id", "tag", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
