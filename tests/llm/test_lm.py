"""Language-model scores: exact base, filter levels, probabilities, smoothing."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from benchloom.llm import lm
from benchloom.llm.arrays import mix
from benchloom.llm.workers import importable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + [""]


def corpus(seed=1, n=300):
    """Texts in which each word is mostly followed by one of two others."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        word, words = draw.randrange(60), []
        for _ in range(draw.randint(0, 40)):
            word = (3 * word + draw.choice([1, 2])) % 60 if draw.random() < 0.9 else draw.randrange(60)
            words.append(draw.choice(["Wort{}", "wort{}"]).format(word) + ("é" if word % 7 == 0 else ""))
        rows.append((k, draw.choice([" ", "\n", "\t "]).join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "unseen thing"), (3, rows[3][1]), (None, "wort1 wort4 wort1")]


def base(texts, train):
    counts = Counter(w for t in train for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    return [
        (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t)))
        for t in texts
    ]


@pytest.mark.parametrize("common", [1 << 19, 8, 0])
def test_base_scores_are_exact_however_few_counts_are_broadcast(spark, common):
    rows = corpus()
    train = [r for r in rows if r[0] is None or r[0] % 3]
    model = lm.fit(spark.createDataFrame(train, "doc_id long, text string"), common_tokens=common)
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model, ["doc_id"]).collect()
    want = base([t for _, t in rows], [t for _, t in train])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key)
    assert got == sorted(((i, *w[:3], round(w[3], 6)) for (i, _), w in zip(rows, want)), key=key)


def test_levels_are_never_too_low_and_seldom_too_high(spark):
    draw = np.random.default_rng(1)
    hashes = mix(np.arange(30_000, dtype=np.uint64))
    counts = np.minimum(draw.zipf(1.6, len(hashes)), 10**9)
    table = spark.createDataFrame([(None, int(h), int(n)) for h, n in zip(hashes.view(np.int64), counts)], "token string, h long, n long").cache()
    known = lm._filter(table, lm.FILTER_BYTES)
    right = np.searchsorted(lm.SCALE, counts, side="right")
    got = known.levels(hashes, 2)
    assert (got >= right).all() and (got > right).mean() < 0.03
    unseen = known.levels(mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64)), 2)
    assert (unseen > 0).mean() < 0.03
    # A filter too small for all levels keeps the higher ones, and those as good.
    small = lm._filter(table, 1 << 16)
    assert small.bits.nbytes == 1 << 16 and small.lowest[1] > 1
    kept = right >= small.lowest[1]
    got = small.levels(hashes, 2)
    assert (got[kept] >= right[kept]).all() and (got[kept] > right[kept]).mean() < 0.03 and (got[~kept] > 0).mean() < 0.03
    table.unpersist()
    few = lm._lowest({1: 1000, 2: 100, 3: 10}, 250)
    assert few == 2 and lm._keys({1: 1000, 2: 100, 3: 10}, few) == 120 and lm._keys({1: 1000, 2: 100, 3: 10}, 1) == 1230


def test_level_of_a_count(spark):
    counts = [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 15, 16, 10**6, 2**40, 3 * 2**39]
    got = spark.createDataFrame([(n,) for n in counts], "n long").select(lm.level_of("n").alias("level")).collect()
    assert [r.level for r in got] == list(np.searchsorted(lm.SCALE, counts, side="right"))


def model_by_hand(train, order, weights):
    """The same model from plain counts, each moved to the middle of its level."""
    counts = Counter()
    for text in train:
        marks = ["<s>", *tokens(text)]
        for k in range(1, order + 1):
            counts.update(tuple(marks[i:i + k]) for i in range(len(marks) - k + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1 and g != ("<s>",))
    distinct = sum(len(g) == 1 and g != ("<s>",) for g in counts)

    def about(gram):
        return lm.MIDDLE[np.searchsorted(lm.SCALE, counts[gram], side="right")] if gram in counts else 0.0

    def log10(text):
        marks, out = ["<s>", *tokens(text)], 0.0
        for i in range(1, len(marks)):
            p = (about((marks[i],)) + 1) / (total + distinct + 1)
            for k in range(2, min(order, i + 1) + 1):
                context, gram = tuple(marks[i - k + 1:i]), tuple(marks[i - k + 1:i + 1])
                p = (min(about(gram), about(context)) + weights[k - 2] * p) / (about(context) + weights[k - 2])
            out += math.log10(p)
        return out

    return log10


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_plain_counts(spark, order):
    rows = corpus(2)
    train, rest = rows[::2], rows[1::2]
    model = lm.fit(spark.createDataFrame(train, "doc_id long, text string"), order=order)
    assert len(model.weights) == order - 1
    by_hand = model_by_hand([t for _, t in train], order, model.weights)
    got = lm.score(spark.createDataFrame(rest, "doc_id long, text string"), model, ["doc_id"]).collect()
    want = {i: by_hand(t) for i, t in rest}
    # The filter sees some n-grams that are not there.
    near = [abs(r.score - want[r.doc_id]) <= 0.02 * abs(want[r.doc_id]) + 0.3 for r in got]
    assert sum(near) >= 0.95 * len(near) and all(r.score <= 0 for r in got)


def test_order_of_words_counts_and_held_out_texts_are_likelier_than_by_unigrams(spark):
    rows = [r for r in corpus(3, 600) if r[0] is not None and r[0] < 600 and len(tokens(r[1])) > 8]
    train, rest = [r for r in rows if r[0] % 4], [r for r in rows if r[0] % 4 == 0]
    mixed = [(i, " ".join(random.Random(i).sample(tokens(t)[:-1], len(tokens(t)) - 1))) for i, t in rest]
    model = lm.fit(spark.createDataFrame(train, "doc_id long, text string"))
    score = lambda rows: {r.doc_id: (r.score, r.base_score) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()}
    right, wrong = score(rest), score(mixed)
    assert sum(right[i][0] > wrong[i][0] for i in right) > 0.95 * len(right)
    assert sum(s for s, _ in right.values()) > 0.8 * sum(b for _, b in right.values())


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit(empty)
    (row,) = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    model = lm.fit(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    assert lm.score(empty, model, ["doc_id"]).count() == 0
    odd = spark.createDataFrame([(1, "a", "x", "y", 5), (1, "a", "x", "y", 5)], "doc_id long, text string, rare string, `Row` string, `more logs` int")
    got = lm.score(odd, model, odd.columns)
    assert got.columns[:5] == odd.columns and [r[:5] for r in got.collect()] == [(1, "a", "x", "y", 5)] * 2
    assert lm.score(odd, model, []).columns == ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    with pytest.raises(ValueError):
        lm.score(odd.withColumnRenamed("rare", "Score"), model, ["Score"])
    long = spark.createDataFrame([(1, "tick tock " * 300_000)], "doc_id long, text string")
    (row,) = lm.score(long, lm.fit(long), ["doc_id"]).collect()
    assert row.n_tokens == row.n_known == 600_001 and row.base_score < row.score <= 0


def test_smoothing_is_fitted_on_all_texts(spark):
    """More texts than a sample of 4,000 would hold: repeated ones that call for little smoothing, beside texts without any order."""
    draw = random.Random(5)
    order = [f"w{k}" for k in range(40)]
    mixed = [" ".join(draw.choice(order) for _ in range(30)) for _ in range(1000)]
    for repeated in (" ".join(order), " ".join(order[::-1]), " ".join(order[::3]), " ".join(order[::7])):
        train = [repeated] * 5000 + mixed
        model = lm.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(4))
        weighted = Counter(train)
        p = 1 / (model.train_tokens + model.distinct + 1)
        counts = Counter()
        for t, n in weighted.items():
            for gram in zip(["<s>", *tokens(t)], tokens(t), strict=False):
                counts[gram] += n
        contexts = Counter()
        for (a, _), n in counts.items():
            contexts[a] += n
        ends = Counter()
        for (_, b), n in counts.items():
            ends[b] += n

        def about(n):
            return lm.MIDDLE[np.searchsorted(lm.SCALE, n, side="right")]

        def fit(w):
            total = 0.0
            for (a, b), n in counts.items():
                context = max(about(contexts[a]) - 1, 0)
                total += n * math.log((min(max(min(about(n), about(contexts[a])) - 1, 0), context) + w * (about(ends[b]) + 1) * p) / (context + w))
            return total

        assert model.weights == [max(lm.WEIGHTS, key=lambda w: (fit(w), -w))]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_fit_and_score_equals_fit_then_score_and_asks_about_a_text_once(spark, order, monkeypatch):
    rows = corpus(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = frame["doc_id"] % 3 != 0
    model = lm.fit(frame.where(train), order=order)
    want = lm.score(frame, model, ["doc_id"]).collect()
    passes, plain = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda *args, **named: passes.append(1) or plain(*args, **named))
    got = lm.fit_and_score(frame, train, ["doc_id"], order=order)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    # One to count, one for each weight but the last, one to score.
    assert len(passes) == max(order, 2)
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 6) for x in r[1:]))
    got, want = sorted(map(key, got.collect())), sorted(map(key, want))
    assert len(got) == len(rows) and got == want


def test_texts_are_scored_in_smaller_pieces_than_they_are_counted():
    batch = pa.RecordBatch.from_arrays([pa.array(["a few words " * 5000] * 40)], names=["text"])
    counted = [b.num_rows for b, _ in lm._texts([batch], "text")]
    scored = [b.num_rows for b, _ in lm._texts([batch], "text", lm._SCORED_BYTES)]
    assert sum(counted) == sum(scored) == 40 and len(scored) > 2 * len(counted)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_a_filter_in_buckets_leaves_no_ngram_out(spark, order, monkeypatch):
    """However small the filter that may be broadcast, the scores are those of a filter with all n-grams."""
    monkeypatch.setattr(lm, "HOME_BYTES", 3000)
    monkeypatch.setattr(lm, "BUCKET_GRAMS", 300)
    rows = corpus(6)
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, home int").repartition(3)
    train = frame["doc_id"] % 3 != 0
    want = lm.score(frame, lm.fit(frame.where(train), order=order), ["doc_id", "home"]).collect()
    got = lm.fit_and_score(frame, train, ["doc_id", "home"], order=order, filter_bytes=1 << 10)
    assert got.columns == ["doc_id", "home", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[1], r[0], *(round(x, 6) for x in r[2:]))
    got, want = sorted(map(key, got.collect()), key=str), sorted(map(key, want), key=str)
    assert len(got) == len(rows) and got == want


def test_a_model_has_all_ngrams_unless_it_is_bounded(spark):
    texts = spark.createDataFrame([(" ".join(f"w{k * 7919 % 100_003}" for k in range(lo, lo + 500)),) for lo in range(0, 40_000, 500)], "text string")
    assert lm.fit(texts).filter.lowest == (1, 1)
    bounded = lm.fit(texts, filter_bytes=1 << 16).filter
    assert bounded.bits.nbytes == 1 << 16 and bounded.lowest != (1, 1)
