"""Exact deduplication by a tree-merge of sorted digest runs.

The input partitions are dealt to ``runs`` runs: a run's distinct digests in
order, each with its smallest identifier and its number of rows.  In each round
every ``fan_in`` neighbouring runs are partners: their pieces of one stretch of
the digests (``bucket``, cut by the first bytes, so that pieces stay in order)
are exchanged to one task, merged in the order of the digests, and one pass over
the merged run keeps each digest's smallest identifier and adds the rows up.
After a few rounds one run is left, spread over all stretches.  An entry meets
at most ``fan_in`` - 1 others in a round, however many copies a text has.  One
join gives the last run's answers to the entries of the first runs (at most
``runs`` a key), and another gives each first run's to its own rows.

An entry's key is the SHA-256 of the normalised text together with its length
and a second hash, so every merge verifies that equal digests mean equal texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import SPACE, land, partitions, pick, text_tag

KEY = ["digest", "n_bytes", "check"]


def normalised(text: str) -> F.Column:
    """The text with each stretch of ASCII white space as one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+", " ")


def _merged(runs: DataFrame, fan_in: int) -> DataFrame:
    """Every ``fan_in`` runs become one: pieces exchanged, merged in order, and their equal neighbours combined on the way."""
    place = ["run", "bucket"]
    partners = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    merged = partners.repartition(*place).sortWithinPartitions(*place, *KEY)
    return merged.groupBy(*place, *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = 64, fan_in: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag, keep_id, group_size, kept, text_sha256.

    Of the rows with equal normalised text the one with the smallest id stays;
    a null id comes after all others; of rows with the same id one stays.  Null
    and empty texts are equal.  ``tag`` is ``text_tag`` of the raw text.  Other
    columns are not looked at.  An empty table gives an empty result.
    """
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("plain", normalised("text"))
    rows = land(
        rows.select(
            "doc_id",
            text_tag(F.col("text")).alias("tag"),
            F.unhex(F.sha2("plain", 256)).alias("digest"),
            F.octet_length("plain").alias("n_bytes"),
            F.xxhash64("plain").alias("check"),
            F.monotonically_increasing_id().alias("row"),
            (F.spark_partition_id() % runs).alias("run"),
        )
    )
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    part = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    bucket = F.shiftright(part * partitions(docs.sparkSession), 32).alias("bucket")
    first_runs = land(rows.groupBy("run", bucket, *KEY).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")))
    merged, left = first_runs, runs
    while left > 1:
        left = math.ceil(left / fan_in)
        merged = _merged(merged, fan_in)
    answers = first_runs.select("run", *KEY).join(merged.select(*KEY, "best", "n"), KEY)
    return rows.join(answers, ["run", *KEY]).select(
        "doc_id",
        "tag",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
