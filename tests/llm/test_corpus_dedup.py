"""Exact, line, paragraph, SimHash and suffix deduplication against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from corpora import PASSAGE, edge_rows, lower, order, table, words
from hypothesis import given, settings
from hypothesis import strategies as st

from brooklet.llm.components import connected
from brooklet.llm.exact_dedup import _merged, exact_dedup
from brooklet.llm.line_dedup import LineRuns, dedup_lines
from brooklet.llm.paragraph_dedup import dedup_units
from brooklet.llm.simhash import covering, fingerprint, near_links, simhash_dedup
from brooklet.llm.suffix_dedup import _Anchors, cut, repeated, repeated_spans
from brooklet.llm.suffix_sort import blind_sort, common, deep_shallow


def rows_of(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=str)


def random_rows(seed, n=60, vocabulary=12):
    """Texts of few words, so that lines, texts and passages come up again and again."""
    draw = random.Random(seed)
    rows = []
    for number in range(n):
        lines = [" ".join(draw.choice(["Alpha", "beta", "gamma", "Delta", "é"]) for _ in range(draw.randint(0, 4))) for _ in range(draw.randint(1, 6))]
        if draw.random() < 0.3 and rows:
            lines.insert(draw.randint(0, len(lines)), PASSAGE[: draw.randint(20, len(PASSAGE))])
        rows.append((draw.choice([number, number, draw.randint(0, n), None]), draw.choice(["\n", "\n\n"]).join(lines)))
    return rows


# --- exact copies


def plain_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    found = []
    for text, ids in groups.items():
        best = min(ids, key=order)
        digest = hashlib.sha256(text.encode()).hexdigest()
        found += [(doc_id, best, len(ids), digest) for doc_id in ids]
    return sorted(found, key=str)


@pytest.mark.parametrize("runs, fan_in", [(64, 4), (64, 8), (5, 2), (1, 2)])
@pytest.mark.parametrize("rows", [edge_rows(), random_rows(1), [], [(None, None)]])
def test_exact(spark, rows, runs, fan_in):
    found = exact_dedup(table(spark, rows).repartition(7), runs=runs, fan_in=fan_in)
    assert rows_of(found, "doc_id", "keep_id", "group_size", "text_sha256") == plain_exact(rows)
    kept = [row for row in found.collect() if row["kept"]]
    assert len(kept) == len({row["text_sha256"] for row in found.collect()})
    assert all(row["doc_id"] == row["keep_id"] for row in kept)


def test_exact_plan_has_no_python(spark):
    plan = exact_dedup(table(spark, edge_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_merges_sorted_runs(spark):
    """Each round: one exchange by stretch and run, one sort, one pass in the order of the digests."""
    runs = spark.createDataFrame([], "run int, bucket long, digest binary, n_bytes int, check long, best struct<a:boolean,b:long,c:long>, n long")
    plan = _merged(runs, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run") == plan.count("Exchange") == 1
    assert plan.count(" Sort [run") == 1 and plan.count("SortAggregate") == 2


# --- lines


def plain_lines(rows):
    def key(line):
        return lower(line.strip(" \t\n\x0b\f\r"))

    first = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), order(doc_id)), order(doc_id))
    found = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [line for line in lines if len(key(line)) < 10 or first[key(line)] == order(doc_id)]
        found.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(found, key=str)


@pytest.mark.parametrize("batches, fan_in", [(4, 3), (1, 2), (7, 2)])
@pytest.mark.parametrize("rows", [edge_rows(), random_rows(2), [], [(None, None), (None, None)]])
def test_lines(spark, rows, batches, fan_in):
    found = dedup_lines(table(spark, rows), batches=batches, fan_in=fan_in)
    assert rows_of(found, "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(rows)


def test_line_runs_are_compacted_and_disjoint(spark):
    runs = LineRuns(spark, fan_in=2)
    seen = set()
    for batch in range(5):
        lines = [(batch, bytes([n])) for n in range(batch, batch + 4)]
        gone = {(row[0], bytes(row[1])) for row in runs.add(spark.createDataFrame(lines, "doc_id long, digest binary")).collect()}
        assert gone == {(batch, digest) for _, digest in lines if digest in seen}
        seen |= {digest for _, digest in lines}
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [bytes(row["digest"]) for level in runs.levels for run in level for row in run.collect()]
    assert sorted(held) == sorted(seen)


def test_lines_with_text_ids(spark):
    rows = spark.createDataFrame([("b", PASSAGE), ("a", PASSAGE), ("c", "x")], "doc_id string, text string")
    assert rows_of(dedup_lines(rows), "doc_id", "n_dropped") == [("a", 0), ("b", 1), ("c", 0)]


# --- paragraphs


def plain_units(rows, unit, min_words):
    end = {"line": r"\n", "paragraph": r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"}[unit]
    units, first = {}, {}
    for doc_id, text, *_ in rows:
        places = [0, *(found.end() for found in re.finditer(end, text or "")), len(text or "")]
        units[doc_id, text] = mine = [(a, b, " ".join(words(lower((text or "")[a:b])))) for a, b in zip(places, places[1:])]
        for a, _, key in mine:
            place = (order(doc_id), text or "", a)
            first[key] = min(first.get(key, place), place)
    found = []
    for doc_id, text, *_ in rows:
        gone = [(a, b, first[key][0]) for a, b, key in units[doc_id, text] if len(key.split(" ")) >= min_words and key and first[key] != (order(doc_id), text or "", a)]
        kept, at = "", 0
        for a, b, _ in gone:
            kept, at = kept + (text or "")[at:a], b
        spans = [(a, b, None if by[0] else by[1]) for a, b, by in gone]
        found.append((doc_id, len(units[doc_id, text]), len(text or ""), spans, kept + (text or "")[at:]))
    return sorted(found, key=str)


@pytest.mark.parametrize("unit, min_words", [("line", 8), ("line", 2), ("paragraph", 2)])
@pytest.mark.parametrize("rows", [edge_rows(), random_rows(3), [], [(None, None)]])
def test_units(spark, rows, unit, min_words):
    rows = [row for number, row in enumerate(rows) if order(row[0]) not in {order(other[0]) for other in rows[:number]}]
    found = dedup_units(table(spark, rows), unit=unit, min_words=min_words).collect()
    mine = [(row["doc_id"], row["n_units"], row["n_chars"], [tuple(span) for span in row["spans"]], row["kept_text"]) for row in found]
    assert sorted(mine, key=str) == plain_units(rows, unit, min_words)


def test_units_of_repeated_rows(spark):
    found = dedup_units(table(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)]))
    assert rows_of(found, "doc_id", "kept_text") == [(1, PASSAGE), (1, PASSAGE), (2, "")]


# --- SimHash


def plain_print(text):
    parts = words(lower(text))
    shingles = [" ".join(parts[at : at + 4]) for at in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64(shingle.encode(), seed=42).intdigest() for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest member of each component of numbers that differ in at most 4 bits."""
    left, label = set(prints), {}
    while left:
        front = [left.pop()]
        group = list(front)
        while front:
            one = front.pop()
            near = {other for other in left if (one ^ other).bit_count() <= 4}
            left -= near
            front += near
            group += near
        label |= {one: min(group) for one in group}
    return label


def test_covering():
    triples = [set(triple) for triple in covering()]
    assert len(triples) == 20
    assert all(any(triple <= set(four) for triple in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("text", [None, "", "A b", "a b C d", "a b c d e f", "É x é X " * 50, " ".join(map(str, range(70_000)))])
def test_fingerprint(text):
    assert fingerprint(text and text.encode()) == plain_print(text)


@pytest.mark.parametrize("rows", [edge_rows(), random_rows(4, 120), [], [(None, None)]])
def test_simhash(spark, rows):
    prints = {(row[0], row[1]): plain_print(row[1]) for row in rows}
    label = plain_components(prints.values())
    least = {}
    for (doc_id, _), one in prints.items():
        least[label[one]] = min(least.get(label[one], order(doc_id)), order(doc_id))
    want = [(row[0], f"{prints[row[0], row[1]]:016x}", least[label[prints[row[0], row[1]]]]) for row in rows]
    want = [(doc_id, one, None if best[0] else best[1]) for doc_id, one, best in want]
    found = simhash_dedup(table(spark, rows))
    assert rows_of(found, "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    kept = {(row["doc_id"], row["tag"]) for row in found.collect() if row["kept"]}
    assert len(kept) == len(least)


@pytest.mark.parametrize("posting_rows", [20_000, 3])
def test_links_of_dense_and_lone_prints(spark, posting_rows):
    draw = random.Random(5)
    prints = {draw.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        base = draw.getrandbits(64)
        prints |= {base ^ sum(1 << bit for bit in draw.sample(range(64), draw.randint(0, 6))) for _ in range(60)}
    signed = [(one - (1 << 64) if one >> 63 else one,) for one in prints]
    edges = near_links(spark.createDataFrame(signed, "print long"), posting_rows)
    label = {row["node"]: row["label"] for row in connected(edges).collect()}
    found, want = defaultdict(set), defaultdict(set)
    for one, least in plain_components(prints).items():
        key = one - (1 << 64) if one >> 63 else one
        want[least].add(key)
        found[label.get(key, key)].add(key)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_dense_postings_give_few_edges(spark):
    base = 0x0123456789ABCDEF
    prints = [(base ^ (1 << a) ^ (1 << b),) for a in range(40) for b in range(a)]  # 780, most of them linked
    assert near_links(spark.createDataFrame(prints, "print long")).count() < 20 * len(prints)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (2, 3)], [(n, n + 1) for n in range(40)], [(n, 50) for n in range(50)] + [(60, 61)]])
def test_connected(spark, edges):
    label = {row["node"]: row["label"] for row in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
            low, high = sorted((parent[a], parent[b]))
            parent = {node: low if at == high else at for node, at in parent.items()}
    assert label == parent


# --- suffixes


def plain_spans(texts, match):
    seen = Counter(text[at : at + match] for text in texts for at in range(len(text) - match + 1))
    found = []
    for text in texts:
        spans = []
        for at in range(len(text) - match + 1):
            if seen[text[at : at + match]] > 1:
                if spans and at <= spans[-1]:
                    spans[-1] = at + match
                else:
                    spans += [at, at + match]
        found.append(spans)
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(c % 3 for c in b) * 3), max_size=14), st.integers(0, 16))
def test_deep_shallow(texts, shallow):
    found, shared = deep_shallow(texts, shallow)
    assert sorted(found) == list(range(len(texts)))
    assert [texts[at] for at in found] == sorted(texts)
    assert shared == [0, *(common(texts[a], texts[b]) for a, b in zip(found, found[1:]))][: len(texts)]
    if texts:
        assert [texts[at] for at in blind_sort(texts, list(range(len(texts))))] == sorted(texts)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=12), st.binary(max_size=12))
def test_common(a, b):
    assert common(a, b) == next((at for at, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=5), st.binary(max_size=9)), min_size=2, max_size=30), st.integers(0, 2))
def test_repeated(pairs, low):
    match, high = 8, 4
    before, after = ([bytes(c % 2 for c in side) for side in sides] for sides in zip(*pairs))

    def strings(left):
        return [(b[:left], a[: match - left]) if len(b) >= left and len(a) >= match - left else None for b, a in zip(before, after)]

    want = []
    for anchor in range(len(before)):
        lefts = [left for left in range(low, high + 1) if strings(left)[anchor] and strings(left).count(strings(left)[anchor]) > 1]
        want.append((min(lefts), max(lefts)) if lefts else None)
    assert repeated(before, after, low, high, match) == want


def test_equal_strings_have_equal_anchors():
    draw = np.random.default_rng(3)
    text = draw.integers(0, 3, 3000).astype(np.uint8)
    text[2000:2200] = text[100:300]
    places, _ = _Anchors(60, 20).find(text, np.array([0, 1000, 1001, 3000]))
    for start in (100, 150, 240):
        mine = set(places[(places >= start) & (places <= start + 40)] - start)
        assert mine and mine == set(places[(places >= start + 1900) & (places <= start + 1940)] - start - 1900)


@pytest.mark.parametrize("group_rows", [20_000, 4, 1])
def test_spans(spark, group_rows):
    draw = random.Random(6)
    shared = ["".join(draw.choice("ab é") for _ in range(n)) for n in (30, 45, 80)]
    texts = []
    for _ in range(40):
        pieces = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 30))) for _ in range(3)]
        pieces.insert(draw.randint(0, 3), draw.choice(shared))
        texts.append("".join(pieces))
    texts += [None, "", "a" * 200, "ab" * 100, texts[0], texts[0], "x"]
    rows = [(number if number % 7 else None, text) for number, text in enumerate(texts)]
    found = repeated_spans(table(spark, rows), match=40, gram=16, group_rows=group_rows).collect()
    data = [(text or "").encode() for text in texts]
    want = [(doc_id, len(text), spans, hashlib.sha256(cut(text, spans)).hexdigest()) for (doc_id, _), text, spans in zip(rows, data, plain_spans(data, 40))]
    mine = [(row["doc_id"], row["n_bytes"], row["spans"], row["kept_sha256"]) for row in found]
    assert sorted(mine, key=str) == sorted(want, key=str)


def test_spans_of_edges(spark):
    rows = edge_rows()
    data = [(row[1] or "").encode() for row in rows]
    found = repeated_spans(table(spark, rows)).collect()
    want = [(row[0], len(text), spans) for row, text, spans in zip(rows, data, plain_spans(data, 400))]
    assert sorted(((row["doc_id"], row["n_bytes"], row["spans"]) for row in found), key=str) == sorted(want, key=str)
    assert repeated_spans(table(spark, [])).collect() == []


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr("brooklet.llm.suffix_dedup.CHUNK", 500)
    draw = random.Random(7)
    text = "".join(draw.choice("abcd") for _ in range(5000))
    data = (text + text[1200:1900]).encode()
    anchors = _Anchors(100, 40)
    from brooklet.llm.suffix_dedup import _pieces

    pieces = [piece for held in _pieces([data, None, b"x"], 100) for piece in held]
    starts = {offset + at for _, offset, piece in pieces for at in range(len(piece) - 99)}
    assert starts == set(range(len(data) - 99)) and all(len(piece) <= 500 for _, _, piece in pieces)
    assert len(anchors.powers) == 501


def test_operators_ignore_other_columns(spark):
    docs = table(spark, edge_rows()).toDF("doc_id", "text", "digest", "anchor", "n", "run", "DOC_ID", "first", "TEXT", "row")
    for found in (exact_dedup(docs), dedup_lines(docs), dedup_units(docs), simhash_dedup(docs), repeated_spans(docs)):
        assert found.count() == len(edge_rows())
    with pytest.raises(ValueError, match="missing columns"):
        exact_dedup(docs, text="nothing")


def test_passages_of_over_fifty_words(spark):
    """Shared passages of 400 bytes and more go from every document, wherever they stand; shorter ones, and all other text, stay."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("etaoinshrdlu", k=draw.randint(3, 10)))
    passages = [" ".join(word() for _ in range(draw.randint(51, 90))) for _ in range(25)]
    rows, held = [], {}
    for number in range(200):
        chosen = draw.choice(passages) if number < 140 else None
        around = [" ".join(word() for _ in range(draw.randint(0, 120))) for _ in range(2)]
        rows.append((number, f"{around[0]} {chosen} {around[1]}" if chosen else around[0] + " clean"))
        held[number] = chosen
    times = {passage: sum(own is passage for own in held.values()) for passage in passages}
    found = {row["doc_id"]: row for row in repeated_spans(table(spark, rows)).collect()}
    assert any(len(passage) < 400 for passage in passages) and sum(len(passage) >= 400 for passage in passages) > 10
    for number, text in rows:
        spans, passage = found[number]["spans"], held[number]
        if passage is None or len(passage) < 398 or times[passage] < 2:  # the blanks on both sides are shared as well
            assert spans == []
        elif len(passage) >= 400:
            begin = text.encode().index(passage.encode())
            assert len(spans) == 2 and spans[0] <= begin and spans[1] >= begin + len(passage)
            assert found[number]["n_bytes"] == len(text.encode())
