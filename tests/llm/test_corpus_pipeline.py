"""The pipeline stage by stage, and the registered queries against their SQL."""

import re
from collections import defaultdict

import pytest
from conftest import DATA
from corpora import edge_rows

import __spark_entry__ as entry
import corpus_pipeline
from brooklet.llm import queries
from brooklet.llm.decontamination import decontaminate
from check import connect, difference

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


def test_registered():
    names = {name.split("_")[0] for name in queries.QUERIES}
    assert names == {f"op{number}" for number in range(1, 14)}
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, db, name):
    assert difference(spark, db, queries.QUERIES[name], queries.SQL[name], DATA) is None


def stages(spark, docs):
    """What each stage gives, written and read again."""
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, found[-1], DATA)
        found.append(spark.createDataFrame(rows.collect(), rows.schema))
    return found


def exact_key(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_stages(spark, docs):
    start, language, exact, near, clean, mixed = stages(spark, docs)
    ids = [[row["doc_id"] for row in df.collect()] for df in (start, language, exact, near, clean, mixed)]
    for before, after in zip((start, language, exact, near), (language, exact, near, clean)):
        assert after.columns == before.columns
        assert {str(row) for row in after.collect()} <= {str(row) for row in before.collect()}
    rows = {str(row) for row in start.collect() if any(c.isalpha() for c in row["text"] or "")}
    assert {str(row) for row in language.collect()} == rows
    groups = defaultdict(list)
    for row in language.collect():
        groups[exact_key(row["text"])].append((row["doc_id"] is None, row["doc_id"] or 0))
    assert sorted((row["doc_id"] is None, row["doc_id"] or 0) for row in exact.collect()) == sorted(map(min, groups.values()))
    from test_corpus_dedup import plain_components, plain_print

    prints = {row["doc_id"]: plain_print(row["text"]) for row in exact.collect()}
    label, least = plain_components(prints.values()), {}
    for doc_id, one in prints.items():
        key = (doc_id is None, doc_id or 0)
        least[label[one]] = min(least.get(label[one], key), key)
    if len(prints) == exact.count():
        assert sorted(ids[3], key=str) == sorted((None if missing else doc_id for missing, doc_id in least.values()), key=str)
    bad = {row["doc_id"] for row in decontaminate(near, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("contaminated").collect()}
    assert set(ids[4]) == set(ids[3]) - bad
    taken, offered = ([(row["doc_id"], row["text"]) for row in df.collect()] for df in (mixed, clean))
    assert set(taken) <= set(offered) and len(taken) == len(set(taken))
    for row in mixed.collect():
        assert row["copies"] > 0 and row["taken"] == row["copies"] * row["size"]
    assert mixed.columns[: len(start.columns)] == start.columns
    return [df.count() for df in (start, language, exact, near, clean, mixed)]


def test_stages(spark):
    counts = check_stages(spark, spark.read.parquet(f"{DATA}/documents.parquet"))
    assert counts[0] > counts[2] > counts[3] > counts[4] > 0


def test_edges(spark):
    rows = [(*row, 1) for row in edge_rows()]
    check_stages(spark, spark.createDataFrame(rows, COLUMNS))
    assert [df.count() for df in stages(spark, spark.createDataFrame([], COLUMNS))] == [0] * 6


def test_nothing_to_learn_from(spark):
    """Texts with a letter stay in the first stage when no text is labelled."""
    docs = spark.createDataFrame([(1, "a clean text", None, "a", 12), (2, "12 34", None, "a", 5), (3, None, None, "a", 0)], COLUMNS)
    assert [row["doc_id"] for row in corpus_pipeline.known_language(spark, docs, DATA).collect()] == [1]


def test_run(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert found.count() > 0 and "copies" in found.columns
