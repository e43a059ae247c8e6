"""A training corpus from the documents: language, copies, near copies, benchmark passages, mix.

``STAGES`` names the stages in order; each takes (session, docs, table folder)
and returns a DataFrame that the next stage gets after it has been written as
Parquet and read again.  All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm.common import scratch, text_tag
from brooklet.llm.decontamination import decontaminate
from brooklet.llm.exact_dedup import exact_dedup
from brooklet.llm.langid import UNKNOWN, identify_letters
from brooklet.llm.mixing import mix
from brooklet.llm.simhash import simhash_dedup

KEY = ["_no_id", "_id", "_tag"]


def _keyed(docs: DataFrame, tag: F.Column) -> DataFrame:
    """``docs`` with columns that are never null and tell documents apart."""
    doc_id = F.col("doc_id")
    return docs.withColumns({"_no_id": doc_id.isNull(), "_id": F.coalesce(doc_id.cast("string"), F.lit("")), "_tag": tag})


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents in ``kept`` (doc_id, tag), with all their columns; one of rows with equal id and text."""
    kept = _keyed(kept, F.col("tag")).select(KEY)
    # The join leaves the rows dealt out and sorted by the key, so taking one per key moves nothing.
    return _keyed(docs, text_tag(F.col("text"))).join(kept, KEY, "left_semi").dropDuplicates(KEY).drop(*KEY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter go.  Those with one stay also when no language could be learned."""
    return _keep(docs, identify_letters(docs).filter((F.col("lang_pred") != UNKNOWN) | F.col("letter")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id."""
    return _keep(docs, exact_dedup(docs).filter("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents, the one with the smallest id."""
    return _keep(docs, simhash_dedup(docs).filter("kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, or too little of it to count."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keep(docs, found.filter("not contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies of each (``copies``) and their words (``taken``).

    Documents with 0 copies are not part of the mix.  Columns of ``docs`` named
    like the new ones give way to them.
    """
    facts = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*[name for name in docs.columns if name.lower() in facts])
    taken = _keyed(mix(docs), F.col("tag")).groupBy(KEY).agg(
        F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"),
        F.sum("copies").alias("copies"), F.sum("taken").alias("taken"),
    )
    rows = _keyed(docs, text_tag(F.col("text"))).join(taken.filter("copies > 0"), KEY)
    return rows.dropDuplicates(KEY).drop(*KEY)


STAGES = [
    ("language", known_language),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mix", mixed),
]

# Trained, hashed and random stages: not for SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = scratch(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
