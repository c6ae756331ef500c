"""Phrase collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from benchloom.llm import phrases
from benchloom.llm.workers import importable

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


def brute(rows, least=10, longest=3, top=2000, share=50):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOWER)):
            found = WORD.findall(piece)
            words[lang] += len(found)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(found[i:i + size]) for i in range(len(found) - size + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in kept.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i:i + size]] = max(inside[p[i:i + size]], a)
        rows = []
        for p, a in kept.items():
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < share * a:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed=1, n=120):
    draw = random.Random(seed)
    # A skewed vocabulary with non-ASCII words and set phrases, in pieces of several kinds.
    vocabulary = [f"w{k}" for k in range(30)] + ["été", "Straße", "\x85x", "日本"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 12)):
            words = [vocabulary[min(int(draw.expovariate(0.2)), len(vocabulary) - 1)] for _ in range(draw.randint(0, 9))]
            if draw.random() < 0.3:
                words[1:1] = draw.choice([["New", "york", "City"], ["kick", "the", "bucket"], ["Ad", "HOC"]])
            parts.append(draw.choice([" ", "\t", "  "]).join(words) + draw.choice([". ", ",", ";", "\n", "\r\n", " ! ", ":", "?", "\x0b"]))
        rows.append((draw.choice(["en", "de", None, "", "a\tb"]), "".join(parts)))
    return rows + [("en", None), (None, ""), ("en", "..;"), ("xx", "lonely words")]


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations_against_brute_force(spark, shards):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert got(phrases.collocations(docs, shards=shards)) == brute(rows)


def test_longer_phrases_fewer_slots_and_a_short_list(spark):
    """With four slots nearly all phrases share one: more is counted, the same comes out."""
    rows = corpus(2, 60)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert got(phrases.collocations(docs, least=4, longest=4, top=5, share=80, slots=4)) == brute(rows, 4, 4, 5, 80)


def test_a_phrase_that_stands_in_one_shard_only_is_counted_in_full(spark):
    """Words and phrase reach the threshold in the last scan of the first circle, so the phrase is counted in a later one."""
    rows = [("en", "filler text here")] * 6 + [("en", "late comer now. " * 12)] + [("en", "filler")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert got(phrases.collocations(docs)) == brute(rows)


def test_repeats_empty_tables_and_other_columns(spark):
    rows = [("en", "red hot chili")] * 30
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, key int, phrase string, n int")
    assert got(phrases.collocations(docs)) == brute(rows) == [("en", 1, "red hot chili", 30, 30, 30, 90, 1_000_000)]
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0 and phrases.phrase_counts(empty).count() == 0
    with pytest.raises(ValueError):
        phrases.phrase_counts(empty, shards=200)


def test_a_very_long_text(spark):
    text = " ".join(random.Random(3).choice("abcdefgh") for _ in range(200_000))
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    assert got(phrases.collocations(docs)) == brute([("en", text)])


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as a corpus of 10**13 words would have."""
    rows = [("en", "a", 1, 7 * 10**12), ("en", "b", 1, 9 * 10**12 + 1), ("en", "a b", 2, 6 * 10**12 + 7), ("en", "", 0, 10**13)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda docs, *_: spark.createDataFrame(rows, "lang string, phrase string, size int, n long"))
    (row,) = phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    a, left, right = 6 * 10**12 + 7, 7 * 10**12, 9 * 10**12 + 1
    assert row["score"] == 1_000_000 * a * a // (left * right)
