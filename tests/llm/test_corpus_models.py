"""Language identification and language-model scoring."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from corpora import edge_rows, lower, table, words

from brooklet.llm import hmm
from brooklet.llm.langid import FOLD, ORDER, OTHER, _grams, _trees, identify_language, train, training_sample
from brooklet.llm.lm_scoring import Settings, baum_welch, score_texts

LATIN = {"en": "the of and to in that it was for on with as his they be at one have this from ", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als ", "es": "de la que el en y a los del se las por un para con no una su al es lo como más "}


def labelled(n=60):
    rows = []
    for number in range(n):
        lang = sorted(LATIN)[number % 3]
        rows.append((number, " ".join(LATIN[lang].split()[number % 5 :] * 3), lang))
    return rows


# --- context trees


class PlainTree:
    """Counts by context, and the probability of a byte by recursion over ever shorter contexts."""

    def __init__(self, texts, alphabet):
        self.alphabet = alphabet
        self.seen = defaultdict(Counter)
        for text in texts:
            for context, byte in self.steps(text):
                for size in range(ORDER + 1):
                    self.seen[context[ORDER - size :]][byte] += 1

    def steps(self, text):
        data = bytes([OTHER] * ORDER) + bytes(FOLD[b] for b in text)
        return ((data[at : at + ORDER], data[at + ORDER]) for at in range(len(text)))

    def chance(self, context, byte):
        shorter = (lambda b: self.chance(context[1:], b)) if context else (lambda b: 1 / len(self.alphabet))
        found = self.seen.get(context)
        if not found:
            return shorter(byte)
        total, distinct = sum(found.values()), len(found)
        rest = 1 - sum(shorter(b) for b in found) if distinct < len(self.alphabet) else 0
        if not rest:
            return found[byte] / total
        return found[byte] / (total + distinct) if byte in found else distinct / (total + distinct) * shorter(byte) / rest

    def bits(self, text):
        known = set(self.alphabet)
        return sum(-math.log2(self.chance(context, byte if byte in known else "new")) for context, byte in self.steps(text))


def plain_grams(lang, texts):
    found = Counter()
    for text in texts:
        data = bytes([OTHER] * ORDER) + bytes(FOLD[b] for b in text)
        for at in range(ORDER, len(data)):
            found[sum(data[at - distance] << (8 * distance) for distance in range(ORDER + 1))] += 1
    return [{"lang": lang, "code": code, "n": n} for code, n in found.items()]


def test_code_lengths(monkeypatch):
    training = {"en": [b"the then that", b"this is it"], "de": ["der für über die".encode(), b"das"]}
    texts = [b"the", "über the Ü!".encode(), b"x", "日本 der".encode(), b"A thE 12 that then", b"that this is it das der die"]
    trees = _trees([gram for lang, own in training.items() for gram in plain_grams(lang, own)])
    seen = {byte for own in training.values() for text in own for byte in bytes(FOLD[b] for b in text)}
    alphabet = [*sorted({OTHER, *FOLD[:128].tolist(), *seen}), "new"]
    begins = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    plain = {lang: PlainTree(own, alphabet) for lang, own in training.items()}
    want = [[plain[lang].bits(text) for lang in trees.langs] for text in texts]
    for slab in (1 << 20, 7, 3):
        monkeypatch.setattr("brooklet.llm.langid.SLAB", slab)
        assert np.allclose(trees.lengths(data, begins), want, rtol=1e-4)


def test_costs_are_probabilities():
    trees = _trees(plain_grams("en", [b"the then that", b"this is it"]) + plain_grams("de", [b"der die das"]), known=[200])
    size = int(trees.symbol.max()) + 1
    for context in (b"the", b"die", b"is ", b"xyz", b"zth", b"  d"):
        before = [np.full(size, trees.symbol[byte]) for byte in reversed(context)]
        assert np.allclose(np.exp2(-trees.costs(np.arange(size), before)).sum(axis=0), 1, atol=1e-4)


@pytest.mark.parametrize("bound", [1, 60_000])
def test_blocks_of_languages_change_nothing(spark, monkeypatch, bound):
    rows = edge_rows() + labelled() + labelled(5) + [(None, "the of and", None)] * 3
    whole = identify_language(table(spark, rows)).collect()
    monkeypatch.setattr("brooklet.llm.langid.BLOCK_BYTES", bound)
    monkeypatch.setattr("brooklet.llm.langid.SENT_LANGS", 0)
    sizes = []
    monkeypatch.setattr("brooklet.llm.langid._trees", lambda grams, known: sizes.append(len({g["lang"] for g in grams})) or _trees(grams, known))
    parts = identify_language(table(spark, rows)).collect()
    assert len(sizes) > 1 and (bound > 1 or set(sizes) == {1})
    order = lambda row: (str(row["doc_id"]), row["tag"], row["lang_pred"])
    assert [order(row) for row in sorted(whole, key=order)] == [order(row) for row in sorted(parts, key=order)]
    pairs = zip(sorted(whole, key=order), sorted(parts, key=order))
    assert all(one["held_out"] == two["held_out"] and math.isclose(one["score"], two["score"], rel_tol=1e-6) for one, two in pairs)


def test_languages_are_told_apart(spark):
    rows = labelled()
    found = {row["doc_id"]: row for row in identify_language(table(spark, rows)).collect()}
    assert all(found[number]["lang_pred"] == lang for number, _, lang in rows)
    assert all(found[number]["held_out"] == (zlib.crc32(str(number).encode()) % 5 == 0) for number, _, _ in rows)
    assert all(0 <= row["score"] <= 1 for row in found.values())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {row["doc_id"]: row for row in identify_language(docs).collect()}
    held = [(row["lang"], found[row["doc_id"]]["lang_pred"]) for row in docs.collect() if found[row["doc_id"]]["held_out"]]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95


def test_language_of_edges(spark):
    rows = edge_rows()
    found = identify_language(table(spark, rows)).collect()
    assert len(found) == len(rows)
    unknown = sum(not any(c.isalpha() for c in row[1] or "") for row in rows)
    assert sum(row["lang_pred"] == "und" for row in found) == unknown
    assert all((row["score"] == 0) == (row["lang_pred"] == "und") for row in found)
    assert identify_language(table(spark, [])).collect() == []
    nothing = identify_language(table(spark, [(1, "text"), (2, None)])).collect()
    assert {(row["lang_pred"], row["score"]) for row in nothing} == {("und", 0.0)}


def test_prediction_does_not_look_at_the_label(spark):
    rows = labelled()
    other = [(number, text, lang if zlib.crc32(str(number).encode()) % 5 else "xx") for number, text, lang in rows]
    one, two = (sorted(map(str, identify_language(table(spark, r)).collect())) for r in (rows, other))
    assert one == two


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(number, lang, text, 1) for number, text, lang in labelled(300)], "doc_id long, lang string, text string, tag long")
    for docs_each, bytes_each in ((400, 5), (10, 20_000)):  # at least one text of each
        assert [lang for trees in train(docs, docs_each, bytes_each) for lang in trees.langs] == sorted(LATIN)


def test_languages_with_long_texts_only(spark):
    rows = [(number, text * (400 if lang == "de" else 1), lang) for number, text, lang in labelled()]
    assert min(len(text) for _, text, lang in rows if lang == "de") > 20_000
    found = {row["doc_id"]: row["lang_pred"] for row in identify_language(table(spark, rows)).collect()}
    assert all(found[number] == lang for number, _, lang in rows)
    # The bound on bytes leaves one text of each language.
    few = identify_language(table(spark, rows), sample_docs=400, sample_bytes=1).collect()
    assert {row["lang_pred"] for row in few} == set(LATIN)


def test_long_texts_are_counted_in_slabs(monkeypatch):
    text = "the then über that".encode()
    want = {row["code"]: row["n"] for row in plain_grams("en", [text])}
    for slab in (1 << 20, 7, 3):
        monkeypatch.setattr("brooklet.llm.langid.SLAB", slab)
        (found,) = _grams([pa.record_batch([pa.array(["en"]), pa.array([text])], ["lang", "text"])])
        assert dict(zip(found.column("code").to_pylist(), found.column("n").to_pylist())) == want


def test_long_sample_is_bounded(spark):
    rows = [(number, lang, text * 10, number) for number, text, lang in labelled(3_000)]
    rows += [(-1, "en", "again " * 500, -1)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, tag long")
    sizes = defaultdict(list)
    for row in training_sample(docs, 20, 5_000).collect():
        sizes[row["lang"]].append(len(row["text"].encode()))
    assert sizes.keys() == LATIN.keys()
    assert all(sum(own) <= 20 * 5_000 and len(own) < 60 for own in sizes.values())


# --- hidden Markov model


def plain_hmm(model, sequence):
    """Log-likelihood, state shares and moves of one sequence."""
    ahead, scale, back = [], [], [np.ones(len(model.start))]
    for place, symbol in enumerate(sequence):
        value = (ahead[-1] @ model.move if place else model.start) * model.emit[symbol]
        scale.append(value.sum())
        ahead.append(value / scale[-1])
    for symbol in sequence[:0:-1]:
        value = model.move @ (model.emit[symbol] * back[0])
        back.insert(0, value / value.sum())
    shares = [a * b / (a * b).sum() for a, b in zip(ahead, back)]
    moves = np.zeros_like(model.move)
    for place in range(len(sequence) - 1):
        step = ahead[place][:, None] * model.move * (model.emit[sequence[place + 1]] * back[place + 1])
        moves += step / step.sum()
    return np.log(scale).sum(), shares, moves


@pytest.mark.parametrize("states", [1, 3])
def test_hmm(states, monkeypatch):
    draw = np.random.default_rng(0)
    symbols = 30
    usual = draw.random(symbols)
    model = hmm.beginning(usual / usual.sum(), states, 1)
    sizes = [1, 2, 5, 127, 128, 129, 300, 700]
    data = draw.integers(0, symbols, sum(sizes)).astype(np.uint16)
    begins = np.cumsum([0, *sizes])
    want = hmm.Counts.none(symbols, states)
    logs = []
    for begin, end in zip(begins, begins[1:]):
        log, shares, moves = plain_hmm(model, data[begin:end])
        logs.append(log)
        want.start += shares[0]
        want.move += moves
        for symbol, share in zip(data[begin:end], shares):
            want.emit[symbol] += share
    for tokens, head in ((1 << 18, 1024), (200, 128), (1 << 18, 1), (1 << 18, 130)):
        monkeypatch.setattr(hmm, "TOKENS", tokens)
        monkeypatch.setattr(hmm, "HEAD", head)
        counts = hmm.Counts.none(symbols, states)
        hmm.expect(model, data, begins, counts)
        assert np.allclose(hmm.log_likelihoods(model, data, begins), logs)
        for name in ("start", "move", "emit"):
            assert np.allclose(getattr(counts, name), getattr(want, name))
        assert np.isclose(counts.log_likelihood, sum(logs))


def test_baum_welch_climbs():
    draw = np.random.default_rng(1)
    sides = [draw.integers(10 * side, 10 * side + 10, 60) for side in draw.integers(0, 2, 40)]
    data, begins = np.concatenate(sides).astype(np.uint16), np.arange(41) * 60
    usual = np.full(20, 0.05)
    model, fits = hmm.beginning(usual, 2, 0), []
    for _ in range(15):
        counts = hmm.Counts.none(20, 2)
        hmm.expect(model, data, begins, counts)
        fits.append(counts.log_likelihood)
        model = hmm.maximise(counts, usual, 0.01)
    assert fits[-1] > fits[0] and all(b > a - 1 for a, b in zip(fits, fits[1:]))


SMALL = Settings(states=2, own_words=5, endings=4, shared_words=8, rounds=2)


def plain_base(rows):
    tokens = [[*words(lower(row[1])), "\n"] for row in rows]
    held = [zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 7 == 2 for row in rows]
    counts = Counter(token for own, out in zip(tokens, held) if not out for token in own)
    total, kinds = sum(counts.values()), len(counts)
    found = []
    for row, own, out in zip(rows, tokens, held):
        base = sum(math.log10((counts[token] + 1) / (total + kinds + 1)) for token in own)
        found.append((row[0], out, len(own), sum(counts[token] > 0 for token in own), total, round(base, 6)))
    return sorted(found, key=str)


@pytest.mark.parametrize("settings", [Settings(), SMALL])
@pytest.mark.parametrize("rows", [edge_rows(), labelled(), [], [(None, None)], [(5, "held out")]])
def test_base_scores(spark, rows, settings):
    found = score_texts(table(spark, rows), settings=settings).collect()
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    mine = [(*(row[name] for name in names), round(row["base_score"], 6)) for row in found]
    assert sorted(mine, key=str) == plain_base(rows)
    assert all(math.isfinite(row["score"]) and row["score"] < 0 for row in found)


def plain_scores(rows, settings):
    """Words to symbols, Baum-Welch rounds and scores, one sequence after the other."""
    tokens = [words(lower(row[1])) for row in rows]
    held = [zlib.crc32(str(row[0]).encode()) % 7 == 2 for row in rows]
    counts = Counter(word.encode() for own, out in zip(tokens, held) if not out for word in own)
    order = sorted(counts, key=lambda word: (-counts[word], word))
    ending = lambda word: settings.own_words + zlib.crc32(word[-3:]) % settings.endings
    symbol = {word: place for place, word in enumerate(order[: settings.own_words])}
    sequences = [np.array([symbol.get(word.encode(), ending(word.encode())) for word in own] + [settings.end]) for own in tokens]
    training = [sequence for sequence, out in zip(sequences, held) if not out]
    usual = np.bincount(np.concatenate(training), minlength=settings.symbols) + 0.5
    usual /= usual.sum()
    model = hmm.beginning(usual, settings.states, settings.seed)
    for _ in range(settings.rounds):
        found = hmm.Counts.none(settings.symbols, settings.states)
        for sequence in training:
            _, shares, moves = plain_hmm(model, sequence)
            found.start += shares[0]
            found.move += moves
            np.add.at(found.emit, sequence, np.array(shares))
        model = hmm.maximise(found, usual, settings.weight)
    within = Counter()
    for word in order[settings.own_words :]:
        within[ending(word)] += counts[word] + 1
    for own, sequence in zip(tokens, sequences):
        inside = sum(math.log10((counts[word.encode()] + 1) / (within[s] + 1)) for word, s in zip(own, sequence) if s >= settings.own_words)
        yield plain_hmm(model, sequence)[0] / math.log(10) + inside


@pytest.mark.parametrize("shared", [10_000, 30])
def test_trained_scores(spark, shared):
    """From the texts to the scores of a trained model, held-out texts included; rare words joined or not."""
    rows = [(number, text) for number, text, _ in labelled(120)] + [(900, "unknown words zzz"), (901, "")]
    settings = Settings(states=3, own_words=20, endings=6, shared_words=shared, rounds=3, weight=2.0)
    found = {row["doc_id"]: row["score"] for row in score_texts(table(spark, rows), settings=settings).collect()}
    wanted = dict(zip([row[0] for row in rows], plain_scores(rows, settings)))
    assert found.keys() == wanted.keys()
    assert np.allclose([found[key] for key in wanted], list(wanted.values()), rtol=1e-9)


def test_symbols_grow_with_the_words(spark):
    assert [Settings().for_words(n).own_words for n in (0, 10_000, 8192 * 256, 10**9)] == [8192, 8192, 16384, 65535 - 512]
    with pytest.raises(ValueError, match="own_words"):
        Settings(own_words=70_000).for_words(1)


def test_rare_words_count_by_joining(spark):
    """Sharing few words or all of them gives the same scores."""
    docs = table(spark, [(n, " ".join(f"w{k}" for k in range(40) if n % (k + 1) == 0)) for n in range(60)])
    few, all_words = ({row["doc_id"]: row["score"] for row in score_texts(docs, settings=Settings(states=2, own_words=5, endings=4, shared_words=n, rounds=1)).collect()} for n in (12, 10_000))
    assert few.keys() == all_words.keys() and np.allclose([few[key] for key in few], [all_words[key] for key in few])


def test_probabilities_of_one_word_texts_sum_to_one(spark):
    """All texts of one word, known or the unknown one of a class, and the end: no more than 1 together."""
    training = [(n, " ".join(f"w{(n * 7 + k) % 23}" for k in range(9))) for n in range(40)]
    probe = [(1000 + n, f"w{n}") for n in range(23)]
    found = score_texts(table(spark, training + probe), settings=SMALL).collect()
    total = sum(10 ** row["score"] for row in found if row["doc_id"] >= 1000)
    assert 0 < total <= 1


def test_every_round_takes_all_texts(spark, monkeypatch):
    """Long texts and more than a few thousand texts: each round's counts are those of all training tokens."""
    rows = [(n, f"w{n % 7} w{n % 11}") for n in range(3_000)] + [(5_000, "long " * 12_000), (5_001, "other " * 12_000)]
    training = [text for doc_id, text in rows if zlib.crc32(str(doc_id).encode()) % 7 != 2]
    assert any(len(text) > 50_000 for text in training)
    seen = []

    def spy(*args):
        seen.append(baum_welch(*args))
        return seen[-1]

    def elsewhere(*args, home=os.getpid(), expect=hmm.expect):
        assert os.getpid() != home, "counts on the driver"
        return expect(*args)

    monkeypatch.setattr("brooklet.llm.lm_scoring.baum_welch", spy)
    monkeypatch.setattr("brooklet.llm.lm_scoring.hmm.expect", elsewhere)
    settings = Settings(states=2, own_words=40, endings=4, rounds=3)
    assert score_texts(table(spark, rows), settings=settings).count() == len(rows)
    assert len(seen) == settings.rounds
    for counts in seen:
        assert np.isclose(counts.emit.sum(), sum(len(text.split()) + 1 for text in training))
        assert np.isclose(counts.start.sum(), len(training))


def test_model_beats_the_base_on_held_out_texts(spark):
    found = score_texts(spark.read.parquet(f"{DATA}/documents.parquet")).filter("held_out").collect()
    assert sum(row["score"] for row in found) > sum(row["base_score"] for row in found)
