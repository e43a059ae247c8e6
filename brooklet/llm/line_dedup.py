"""Line deduplication against levelled sorted runs of line hashes.

``LineRuns`` holds what earlier batches have shown: sorted runs of (digest,
first document), in levels.  A new batch is merge-joined with the runs: lines
that a run knows go, digests that no run knows form the batch's own run on
level 0.  When a level has ``fan_in`` runs, they are compacted into one run of the
next level.  The runs of all levels hold disjoint digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm.common import BLANKS, land, lower_ascii, partitions, pick, scratch, text_tag

# Ids looked at to cut a table into batches; the cuts may be anywhere without changing the result.
SAMPLED_IDS = 2_000


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Sorted runs of line digests, each with the first document that held the line."""

    def __init__(self, spark: SparkSession, fan_in: int = 3) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[DataFrame]] = []

    def _sorted_run(self, entries: DataFrame) -> DataFrame:
        return land(entries.repartition(partitions(self.spark), "digest").sortWithinPartitions("digest"))

    def add(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (doc_id, digest, ...) to drop; their digests join the runs.

        A line goes when an earlier batch held its digest, or a smaller id of
        this batch does.  Batches come in order of their ids; null ids are last
        and count as one document.
        """
        judged = lines.groupBy("digest").agg(
            F.min("doc_id").alias("first"),
            F.coalesce((F.min("doc_id") != F.max("doc_id")) | F.max(F.col("doc_id").isNull()), F.lit(False)).alias("shared"),
            F.lit(False).alias("known"),
        )
        for run in (run for level in self.levels for run in level):
            seen = run.select("digest", F.lit(True).alias("seen"))
            judged = judged.join(seen, "digest", "left")
            judged = judged.withColumn("known", F.col("known") | F.col("seen").isNotNull()).drop("seen")
        judged = land(judged)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._sorted_run(judged.filter("not known").select("digest", "first")))
        self._compact()
        verdicts = judged.filter("known or shared").select("digest", "first", "known")
        later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
        return lines.join(verdicts, "digest").filter(F.col("known") | later).select(lines.columns)

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                merged = level[0]
                for run in level[1:]:
                    merged = merged.unionByName(run)
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._sorted_run(merged.groupBy("digest").agg(F.min("first").alias("first"))))
                self.levels[depth] = []


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of the batch of ``doc_id``; batches follow each other in order of ids, null ids are in the last."""
    ids = docs.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED_IDS)
    known = sorted(row[0] for row in ids.collect())
    cuts = sorted({known[len(known) * place // batches] for place in range(1, batches)} if known else ())
    number = F.lit(len(cuts))
    for place, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("doc_id") < F.lit(cut), place).otherwise(number)
    return number.cast("int")


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, batches: int = 4, fan_in: int = 3
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    A line whose key (see ``line_key``) has at least ``min_chars`` code points and
    also occurs in a document with a smaller id is dropped; the other lines stay,
    joined by line feeds.  A null or empty text is one empty line.  Rows with
    the same id are one document; null ids come last and are one document too.
    Other columns are not looked at.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("tag", text_tag(F.col("text")))
    lines = rows.select("doc_id", "tag", _batch_of(rows, batches).alias("batch"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    path = scratch(spark, "lines")
    lines.select("doc_id", "tag", "pos", F.unhex(F.md5("key")).alias("digest"), "batch").write.partitionBy("batch").parquet(path)
    schema = lines.select("doc_id", "tag", "pos", F.lit(b"").alias("digest"), "batch").schema
    stored = spark.read.schema(schema).parquet(path)
    runs, dropped = LineRuns(spark, fan_in), None
    for batch in range(batches):
        gone = runs.add(stored.filter(F.col("batch") == batch).drop("batch"))
        dropped = gone if dropped is None else dropped.unionByName(gone)
    places = dropped.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("places"))
    places = places.withColumnsRenamed({"doc_id": "other_id", "tag": "other_tag"})
    mine = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("tag") == F.col("other_tag"))
    found = rows.join(places, mine, "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.array_join(F.transform(stay, lambda place: F.get(F.col("lines"), place)), "\n")
    return found.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
