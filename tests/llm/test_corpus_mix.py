"""Mixing sources: targets, expectations, and words taken."""

from collections import Counter, defaultdict

import pytest
from corpora import edge_rows, table, words
from pyspark.sql import functions as F

from brooklet.llm.common import pick
from brooklet.llm.mixing import _numbered, mix


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Sharing again what is above the limits, until nothing is."""
    order = sorted(sizes, key=lambda source: (source is None, (source or "").encode()))
    weight = {source: weights[place % len(weights)] for place, source in enumerate(order)}
    target, free, left = {}, list(order), sum(sizes.values())
    while free:
        shares = {source: left * weight[source] / sum(weight[s] for s in free) for source in free}
        above = [source for source in free if shares[source] > cap * sizes[source]]
        if not above:
            return target | shares
        for source in above:
            target[source] = cap * sizes[source]
            left -= target[source]
            free.remove(source)
    return target


def sized(spark, per_source, seed=1):
    rows, number = [], 0
    for source, n in per_source.items():
        for place in range(n):
            number += 1
            rows.append((number, " ".join(["w"] * (1 + (number * seed * 7919) % 50)), None, source))
    return rows


@pytest.mark.parametrize("bucket", [64, 3])
@pytest.mark.parametrize("per_source", [{"a": 300, "b": 40, "C": 5, None: 30}, {"a": 200}, {"x": 2, "y": 2000}, {}])
def test_mix(spark, per_source, bucket):
    rows = sized(spark, per_source)
    found = mix(table(spark, rows), bucket=bucket).collect()
    assert sorted(row["doc_id"] for row in found) == sorted(row[0] for row in rows)
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len(words(row[1]))
    target = plain_targets(sizes)
    taken = Counter()
    for row in found:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(target[row["source"]])
        assert row["taken"] == row["copies"] * row["size"] <= 3 * row["size"]
        ratio = target[row["source"]] / sizes[row["source"]]
        assert int(ratio - 1e-9) <= row["copies"] <= int(ratio + 1 + 1e-9)
        taken[row["source"]] += row["taken"]
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 50  # the largest document


def test_reruns_agree_however_the_rows_are_dealt(spark):
    docs = table(spark, sized(spark, {"a": 200, "b": 100, None: 50}))
    runs = [sorted(map(str, mix(docs.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    assert sorted(map(str, mix(docs, seed=1).collect())) != runs[0]


def test_expectations(spark):
    """Over many sources alike, documents are taken target / source size times on average, whatever their size."""
    rows, number = [], 0
    for source in range(600):
        for size in (2, 3, 5, 8):
            number += 1
            rows.append((number, "w " * size, None, f"s{source:03}"))
    copies, ratio = defaultdict(list), {}
    for row in mix(table(spark, rows), bucket=4).collect():
        key = (int(row["source"][1:]) % 3, row["size"])
        copies[key].append(row["copies"])
        ratio[key] = row["target"] / row["source_size"]
    for key, found in copies.items():
        assert len(found) == 200 and abs(sum(found) / 200 - ratio[key]) < 0.15


def test_edges(spark):
    rows = edge_rows()
    found = mix(table(spark, rows)).collect()
    assert len(found) == len(rows)
    assert Counter((row["doc_id"], row["size"], row["source"]) for row in found) == Counter((row[0], len(words(row[1])), row[3]) for row in rows)
    assert all(row["taken"] == 0 for row in found if row["size"] == 0)
    assert mix(table(spark, [])).collect() == []
    assert [row["taken"] for row in mix(table(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_many_equal_rows_spread_over_buckets(spark):
    """A third of the rows equal in id and text, or without an id: settled one by one, alike in every rerun."""
    rows = sized(spark, {"a": 200}) + [(7, "one text", None, "a")] * 150 + [(None, "no id", None, "b")] * 90
    found = mix(table(spark, rows), bucket=4, block=16)
    assert Counter((row["doc_id"], row["size"]) for row in found.collect()) == Counter((row[0], len(words(row[1]))) for row in rows)
    copies = Counter(row["copies"] for row in found.filter("doc_id = 7 and size = 2").collect())
    assert len(copies) == 2 and sum(copies.values()) == 150  # neither all of them nor none get the copy left to chance
    again = mix(table(spark, rows[::-1]).repartition(7), bucket=4, block=16)
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    whole = mix(table(spark, rows), bucket=4, block=1000)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_equal_rows_share_no_bucket_beyond_its_size(spark):
    numbered = _numbered(pick(table(spark, [(7, "one text", None, "a")] * 1000), doc_id="doc_id", text="text"), 64)
    assert sorted(row["nth"] for row in numbered.collect()) == list(range(1000))
    per_task = numbered.groupBy(F.spark_partition_id()).count()
    assert per_task.count() > 1


def test_plan_has_no_python(spark):
    plan = mix(table(spark, edge_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
