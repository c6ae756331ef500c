"""Operators on texts against brute force, with NULLs, empty and long texts, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from benchloom.llm import decontaminate, mixing, near, repeats, suffixes
from benchloom.llm.workers import importable

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


@pytest.fixture()
def docs(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


def prose(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 6))) for _ in range(n)]


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


@pytest.fixture()
def corpus():
    shared, other = prose(1, 60), prose(2, 200)
    long = prose(3, 4000)
    return [
        (1, " ".join(prose(4, 30) + shared + prose(5, 30))), (2, " ".join(prose(6, 5) + shared)),
        (3, " ".join(other)), (4, " ".join(other)), (4, " ".join(other)), (5, "\n".join(other[:150]) + "\tend"),
        (6, None), (7, ""), (8, "  \n "), (9, "one"), (10, " ".join(long)), (11, " ".join(long[1000:1100] * 3)),
        (None, " ".join(shared)), (12, "same " * 90), (13, " ".join(other[:100] + ["changed"] + other[101:])), (14, "x" * 900),
    ]


def test_repeats_against_brute_force(docs, corpus):
    order = sorted(set(corpus), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, want = set(), {}
    for key, text in order:
        words = SPACED.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = [w for i, w in enumerate(words) if i not in gone]
        want[key, text] = (len(words), len(gone), sha(" ".join(kept).encode()))
    got = repeats.repeats(docs(corpus)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((k, *want[k, t]) for k, t in corpus)


def test_repeats_of_equal_ids_and_empty_table(docs):
    text = " ".join(prose(9, 25))
    got = {r.n_words: r.n_removed for r in repeats.repeats(docs([(1, text), (1, text + " more")])).collect()}
    assert got == {25: 0, 26: 25}
    assert repeats.repeats(docs([])).count() == 0
    with pytest.raises(ValueError):
        repeats.repeats(docs([]), length=30, first=10)


def brute_bytes(rows, length):
    found = Counter(t.encode()[i:i + length] for _, t in rows for i in range(len(t.encode()) - length + 1) if t)
    out = []
    for key, text in rows:
        raw = text.encode()
        gone = set()
        for i in range(len(raw) - length + 1):
            if found[raw[i:i + length]] > 1:
                gone.update(range(i, i + length))
        spans = sum(i in gone and i - 1 not in gone for i in range(len(raw)))
        out.append((key, len(raw), len(gone), spans, sha(bytes(b for i, b in enumerate(raw) if i not in gone))))
    return Counter(out)


def thue_morse(n: int) -> tuple[str, str]:
    """A word of 2**n letters and its complement: equal under every polynomial hash modulo 2**64 from 2**11 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [11, 13, 17])
def test_long_words_that_polynomial_hashes_cannot_tell_apart(docs, n):
    word, other = thue_morse(n)
    rest = prose(21, 24)
    rows = [(1, " ".join([*rest[:12], word, *rest[12:]])), (2, " ".join([*rest[:12], other, *rest[12:]]))]
    assert {r.doc_id: r.n_removed for r in repeats.repeats(docs(rows)).collect()} == {1: 0, 2: 0}
    # Five shingles of 21 differ in each text.
    classes = {r.doc_id: r["class"] if "class" in r.asDict() else r[1] for r in near.near_duplicates(docs(rows)).collect()}
    assert classes[1] != classes[2]


@pytest.mark.parametrize("length", [64, 100, 400])
def test_suffix_dedup_against_brute_force(docs, corpus, length):
    rows = [(k, t or "") for k, t in corpus if k != 10] + [(20, "ab" * 700), (21, "ab" * 40 + "c" * 500)]
    got = suffixes.suffix_dedup(docs([(k, t or None) for k, t in rows]), length=length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, length)


def test_suffix_dedup_with_more_homes_and_buckets(docs, corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "HOME_BYTES", 2000)
    monkeypatch.setattr(suffixes, "BUCKET_ENTRIES", 100)
    rows = [(k, t or "") for k, t in corpus if k != 10]
    got = suffixes.suffix_dedup(docs(rows), length=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, 100)
    assert suffixes.suffix_dedup(docs([])).count() == 0


def test_suffix_dedup_of_strings_with_equal_hashes(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "HOME_BYTES", 100)
    # Thue-Morse strings and their complements collide in every polynomial hash modulo 2^64.
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "!" + " ".join(prose(8, 400))), (4, "?" + " ".join(prose(8, 400)))]
    got = suffixes.suffix_dedup(docs(rows), length=1024).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, 1024)


@pytest.mark.parametrize("common", [0, 64])
def test_suffix_merge_between_homes(common):
    """Homes meet by anchors, also by common ones, in merges as small as can be."""
    shared, draw = prose(31, 300), random.Random(5)
    texts = [" ".join(prose(40 + i, 40) + shared[i * 10:i * 10 + 150] + prose(60 + i, draw.randint(5, 40))) for i in range(12)]
    homes = [suffixes._Home(pa.table({"key": [str(i)], "n": [1], "text": [t]}), 100) for i, t in enumerate(texts)]
    rows = []
    for i, home in enumerate(homes):
        starts = [np.flatnonzero(np.arange(len(p.flat)) + 100 <= p.end) for p in home.pieces]
        rows += [(i, *r[1:]) for r in suffixes._stretches_of(home, starts, np.full(len(home.values), not common), 1)]
    names = ["home", "anchors", "begins", "sizes", "marks", "bytes"]
    table = pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})
    found = suffixes._merge(100)((pa.scalar(0),), table)
    got = {h: np.frombuffer(x, np.int64).reshape(-1, 2) for h, x in zip(found["home"].to_pylist(), found["intervals"].to_pylist(), strict=True)}
    times = Counter(t.encode()[i:i + 100] for t in texts for i in range(len(t.encode()) - 99))
    for i, text in enumerate(texts):
        raw = text.encode()
        want = [k for k in range(len(raw) - 99) if times[raw[k:k + 100]] > 1]
        assert [k for a, b in got.get(i, []) for k in range(a, b + 1)] == want and want


def test_a_home_keeps_little_beside_its_bytes():
    texts = [" ".join(prose(80 + i, 9000)) for i in range(20)]
    home = suffixes._Home(pa.table({"key": [str(i) for i in range(20)], "n": [1] * 20, "text": texts}), 400)
    kept = [x.nbytes for p in home.pieces for name, x in vars(p).items() if name not in ("step", "back") and isinstance(x, np.ndarray)]
    assert sum(kept) < 5 * sum(len(t.encode()) for t in texts)


def test_without_repeats_keeps_columns(docs):
    shared = " ".join(prose(7, 200))
    rows = [(1, "a " + shared, "s"), (2, "b " + shared, "t"), (3, None, "u"), (4, "é", "v")]
    out = suffixes.without_repeats(docs(rows, "doc_id long, text string, spans string"))
    assert out.columns == ["doc_id", "text", "spans"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1].startswith("a") and len(got[1]) < 5 and got[3] is None and got[4] == "é"


def brute_hits(text, items, n=13):
    words = PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, named = set(), set()
    for key, item in items:
        own = PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in item or ""))
        m = min(n, len(own))
        windows = {tuple(own[i:i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i:i + m]) in windows:
                hit.update(range(i, i + m))
                named.add(str(key))
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("block", [500_000, 20])
def test_decontamination_against_brute_force(docs, corpus, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    items = [(100, " ".join(prose(1, 60)[5:40]).upper()), (9, "ONE!"), (11, ""), (12, None), (3, " ".join(prose(2, 200)[:13])), (3, " ".join(prose(2, 200)[:13]))]
    found = decontaminate.scan(docs(corpus), docs(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.hit, tuple(r.hit_items)) for r in found.withColumn("hit", decontaminate.n_hit()).collect())
    want = Counter()
    for key, text in corpus:
        words, hit, named = brute_hits(text, items)
        want[key, words, hit, tuple(named)] += 1
    assert got == want


def test_decontamination_edges(docs):
    items = docs([(1, " ".join(prose(1, 20)))], "item_id long, text string")
    rows = [(1, " ".join(prose(1, 20)), "x"), (2, " ".join(prose(1, 20) + prose(8, 500)), "y"), (3, None, "z")]
    frame = docs(rows, "doc_id long, text string, HIT_ITEMS string")
    assert sorted(r.doc_id for r in decontaminate.clean_documents(frame, items).collect()) == [2, 3]
    with pytest.raises(ValueError):
        decontaminate.scan(frame, items)
    cut = decontaminate.without_spans(decontaminate.scan(docs([(1, "Left, " + " ".join(prose(1, 20)) + "; right")]), items)).first()
    assert cut.text == "Left, ; right"
    assert decontaminate.scan(docs([]), items).count() == 0
    assert decontaminate.scan(docs([(1, "a b")]), docs([], "item_id long, text string")).first().hit_items == []


def shingled(text):
    words = text.lower().split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def similar(rows):
    """Weighted Jaccard similarity, with weights by the definition."""
    sets = [shingled(t) for _, t in rows]
    df = Counter(s for x in sets for s in x)
    least = max(len(rows) / near.COMMON, 2)
    idf = {s: math.sqrt(math.log1p(len(rows) / n if n >= least else near.COMMON)) for s, n in df.items()}

    def weigh(i, j):
        x, y = sets[i], sets[j]
        return sum(idf[s] * n for s, n in (x & y).items()) / sum(idf[s] * n for s, n in (x | y).items())

    return weigh


@pytest.mark.parametrize("block", [128, 8])
def test_near_duplicates_against_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    base = prose(11, 120)
    rows = []
    for k in range(60):  # copies with one to five changes: some pairs are links, others are connected through third ones
        words, draw = list(base), random.Random(k)
        for _ in range(1 + k % 5):
            words[draw.randrange(120)] = f"new{k % 3}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(prose(50 + k, 80))) for k in range(20)] + [(200, rows[0][1].upper()), (201, rows[0][1]), (201, rows[0][1])]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    weigh = similar(rows)
    for i in range(len(rows)):
        for j in range(i):
            if weigh(i, j) >= 0.8 - 1e-9:
                parent[root(i)] = root(j)
    members = {}
    for i, (key, _) in enumerate(rows):
        members.setdefault(root(i), []).append(key)
    want = Counter((key, min(m), len(m)) for m in members.values() for key in m)
    got = near.near_duplicates(docs(rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want


def test_near_duplicates_edges(docs):
    text = " ".join(prose(12, 40))
    rows = [(1, None, 1), (2, "", 2), (3, " ", 3), (4, "one two", 4), (5, "One  two", 5), (None, text, 6), (7, text, 7), (7, text, 8), (None, "alone here", 9)]
    frame = docs(rows, "doc_id long, text string, kept_id int")
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near.near_duplicates(frame).collect())
    assert got == Counter([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 2), (5, 4, 2), (None, 7, 3), (7, 7, 3), (7, 7, 3), (None, None, 1)])
    kept = near.one_of_each(frame)
    assert kept.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, None), (2, ""), (3, " "), (4, "one two"), (7, text), (None, "alone here")]) 
    assert near.near_duplicates(docs([])).count() == 0


def test_near_duplicates_of_many_texts_without_id(docs):
    """The third of the rows without an id: each text is found by its own hash, copies and near copies too."""
    texts = [prose(300 + k, 60) for k in range(12)]
    rows = [(None, " ".join(t)) for t in texts for _ in range(3)] + [(None, " ".join([*t[:-1], "changed"])) for t in texts[:4]]
    rows += [(k, " ".join(prose(400 + k, 60))) for k in range(40)] + [(5, " ".join(texts[7])), (5, " ".join(texts[8][:-1]))]
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near.near_duplicates(docs(rows)).collect())
    want = Counter({(None, None, 4): 16, (None, None, 3): 18, (None, 5, 4): 6, (5, 5, 4): 2})
    want.update((k, k, 1) for k in range(40))
    assert got == want
    assert near.one_of_each(docs(rows)).count() == 12 + 40


def test_frequent_shingles_weigh_less(docs):
    boiler = prose(13, 60)
    rows = [(k, " ".join(boiler + prose(1000 + k, 40))) for k in range(150)]
    weights = near.document_frequencies(docs(rows), "text")
    assert len(weights.frequent) == 56 and max(weights.idf) < weights.other * 0.6
    assert {r.class_size for r in near.near_duplicates(docs(rows)).collect()} == {1}


def weighed_by_all_frequencies(rows, total):
    """Weighted Jaccard similarity under sqrt(log(1 + documents / df)) of every shingle."""
    sets = [shingled(t) for _, t in rows]
    df = Counter(s for x in sets for s in x)
    idf = {s: math.sqrt(math.log1p(total / n)) for s, n in df.items()}
    return lambda i, j: sum(idf[s] * n for s, n in (sets[i] & sets[j]).items()) / sum(idf[s] * n for s, n in (sets[i] | sets[j]).items())


@pytest.mark.parametrize(("home", "bucket", "block"), [(4 << 20, 1_500_000, 128), (2000, 300, 8)])
def test_near_duplicates_by_all_document_frequencies(docs, monkeypatch, home, bucket, block):
    """Every shingle weighs by its own document frequency, whether its documents are in one home or in many."""
    for name, value in (("HOME_BYTES", home), ("BUCKET_SHINGLES", bucket), ("BLOCK", block)):
        monkeypatch.setattr(near, name, value)
    base, rows = prose(11, 120), []
    for k in range(60):
        words, draw = list(base), random.Random(k)
        for _ in range(1 + k % 3):
            words[draw.randrange(120)] = f"new{k % 2}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(prose(50 + k, 80) + ["again and"] * (k % 4))) for k in range(20)] + [(201, rows[0][1]), (201, rows[0][1])]
    rows += [(300 + k, " ".join(prose(90 + k // 2, 70)[:70 - k % 2])) for k in range(16)]
    # Rows without words are documents too.
    empty = [(400, None), (None, None), (401, "  "), (None, "  ")]
    weigh, label = weighed_by_all_frequencies(rows, len(rows + empty)), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and weigh(i, j) >= 0.8 - 1e-9:
                label = [label[j] if x == label[i] else x for x in label]
    members = {x: [key for (key, _), y in zip(rows, label, strict=True) if x == y] for x in set(label)}
    want = Counter((key, min(m), len(m)) for m in members.values() for key in m)
    sizes = sorted(map(len, members.values()))
    assert len(sizes) > 30 and sizes[-1] > 9
    got = near.near_duplicates(docs(rows + empty), common=None).collect()
    alone = Counter([(400, 400, 1), (None, None, 1), (401, 401, 1), (None, None, 1)])
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want + alone
    assert near.near_duplicates(docs([]), common=None).count() == 0


def test_frequencies_of_all_shingles_are_exact(docs, monkeypatch):
    monkeypatch.setattr(near, "HOME_BYTES", 500)
    monkeypatch.setattr(near, "BUCKET_SHINGLES", 50)
    texts = [" ".join(prose(k % 7, 20 + k % 5)) for k in range(40)] + ["one two", "One  TWO", "", None, " ".join(prose(1, 22))]
    frame = docs(list(enumerate(texts)))
    signed = near.text_signatures(frame, near.Weights(np.zeros(0), np.zeros(0), 2.0, len(texts)), "text").collect()
    assert len(signed) == len(set(texts) - {None})
    df = Counter(s for t in texts if t and t.strip() for s in shingled(t))
    by_own = {hashlib.sha256(t.encode()).digest(): t for t in texts if t is not None}
    for r in signed:
        found = np.frombuffer(r.frequencies, np.int64).tolist()
        text = by_own[bytes(r.own)]
        assert sorted(found) == sorted(df[s] for s in shingled(text)) if text.strip() else found == []


def test_pipeline_weighs_a_shingle_of_a_tenth_of_the_documents(spark, docs):
    """Ten pages that share a tenth's boilerplate are not copies: shingles in less than an eighth weigh by their frequency too."""
    boiler = prose(13, 120)
    rows = [(k, " ".join((boiler if k < 10 else prose(2000 + k, 120)) + prose(1000 + k, 12))) for k in range(100)]
    assert corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").count() == 100


def test_mixing(docs, spark):
    rows = []
    for s, source in enumerate(["b", "a", None, "B", "tiny"]):
        for k in range(5 if source == "tiny" else 120):
            rows.append((len(rows), " ".join(["w"] * (1 + (k * 37 + s) % 300 if source != "tiny" else 3)), source))
    rows += [(9001, None, "a"), (9002, "", "b"), (9003, " \n", None), (9003, " \n", None)]
    frame = docs(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = Counter(), Counter(), {}
    names = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.size == len(SPACED.findall(dict((k, t or "") for k, t, _ in rows)[r.doc_id])) and 0 <= r.taken <= 3 * r.size
        sizes[names[r.doc_id]] += r.size
        taken[names[r.doc_id]] += r.taken
        targets[names[r.doc_id]] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        free -= over
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    again = mixing.mix(frame.orderBy(F.desc("doc_id")).repartition(3)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(docs([], "doc_id long, text string, source string")).count() == 0
    assert "copies" in mixing.mixed_documents(frame).columns


def test_mixed_documents_beside_clashing_names(docs):
    rows = [(k, f"word {k}", "ab"[k % 2], 1, 2, 3) for k in range(8)]
    frame = docs(rows, "doc_id long, text string, source string, `of` int, taken int, copies int")
    got = mixing.mixed_documents(frame)
    assert got.columns == [*frame.columns, "_copies"] and 0 < got.count() <= 8
    assert got.where("`of` <> 1 OR taken <> 2 OR copies <> 3").isEmpty()


def test_near_copies_in_a_larger_group_stay_together_in_a_large_table(docs):
    """A changed shingle must not weigh more and more with the size of the table, as no group of near copies would stay one class."""
    base, rows = prose(21, 200), []
    for k in range(60):
        words = list(base)
        for at in range(4):
            words[10 + 40 * at + k % 30] = f"new{k}x{at}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(prose(5000 + k, 12))) for k in range(5000)]
    # Each is like the base, by 0.81 if all shingles weigh alike, and less like the others.
    rows.append((60, " ".join(base)))
    classes = {r.doc_id: r.class_size for r in near.near_duplicates(docs(rows), common=None).collect()}
    assert all(classes[k] == 61 for k in range(61)) and sum(n > 1 for n in classes.values()) == 61
