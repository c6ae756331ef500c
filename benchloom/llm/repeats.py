"""Removal of word sequences that occurred earlier, by level-wise doubling.

Windows start at a short length. Those whose hash occurs twice in the corpus are extended to twice the length;
all others are out, since a window that repeats repeats in both halves. That goes on until no
candidate survives or the asked length is reached, where the first occurrence of each
sequence stays and the words of later ones go.

Documents are dealt to homes by their id. A home ships one entry per distinct hash of its
windows, so a passage in a third of all documents is one entry per home; the answers
come back as bits in the order the home shipped in, so no position travels at the weak levels.
All levels read the texts from one shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from benchloom.llm.arrays import SECOND_STEP, SPACED, U64, WINDOW_STEP, Words, words
from benchloom.llm.frames import parts_for, text_total

HOME_BYTES = 8 << 20
# Distinct windows of all homes in one bucket of hashes.
BUCKET_WINDOWS = 2_500_000

_BITS = "home long, level int, bucket long, bits binary, more binary"
_SHIPPED = "bucket long, home long, entries binary"
_LAST = np.iinfo(np.int64).max


class _Home:
    """Documents of one home in order of (id, text); equal rows count as one document."""

    def __init__(self, table: pa.Table) -> None:
        # doc_id first, NULL last, then the text, so that every run sees one order.
        order = pa.compute.sort_indices(table, [("id", "ascending"), ("text", "ascending")], null_placement="at_end")
        self.table = table.take(order)
        text = self.table["text"].combine_chunks()
        ids = self.table["id"].combine_chunks()
        self.ids = pa.compute.fill_null(ids, _LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: Words = words(text, SPACED)
        n = len(self.ids)
        same_id = np.concatenate(([False], self.ids[1:] == self.ids[:-1])) if n else np.zeros(0, bool)
        copy = np.zeros(n, bool)
        for row in np.flatnonzero(same_id):
            copy[row] = text[int(row)].as_py() == text[int(row) - 1].as_py() and ids[int(row)].is_valid == ids[int(row) - 1].is_valid
        self.copy = copy
        # How many documents of the same id stand before.
        sub = np.zeros(n, np.int64)
        for row in np.flatnonzero(same_id):
            sub[row] = sub[row - 1] + (not copy[row])
        self.sub = sub
        self.row = self.words.text_of()

    def level(self, n: int, step: np.uint64 = WINDOW_STEP) -> tuple[np.ndarray, np.ndarray]:
        """Windows of documents that are no copies."""
        at, hashes = self.words.windows(n, step)
        kept = ~self.copy[self.row[at]]
        return at[kept], hashes[kept]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _cut_by(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each run of an ascending array."""
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True)] if len(bucket) else []


def _survivors(home: _Home, bits: pa.Table, lengths: list[int], upto: int) -> np.ndarray:
    """First words of the windows of lengths[upto] whose halves repeat, going up from the first level."""
    at = home.level(lengths[0])[0]
    for level in range(upto):
        at, hashes = _at_level(home, lengths[level], at)
        unique, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated = (n > 1) | _answers(bits, level, "bits", len(unique))
        good = np.zeros(len(home.words.hashes) + lengths[level + 1] + 1, dtype=bool)
        good[at[repeated[inverse]]] = True
        at = np.flatnonzero(good[:-lengths[level]] & good[lengths[level]:])
    return at


def _at_level(home: _Home, n: int, at: np.ndarray, step: np.uint64 = WINDOW_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that start at `at`, those of n words in one document, and their hashes."""
    every, hashes = home.level(n, step)
    if len(at) == len(every):
        return every, hashes
    place = np.searchsorted(every, at)
    place[place == len(every)] = 0
    there = every[place] == at if len(every) else np.zeros(len(at), bool)
    return at[there], hashes[place[there]] if len(every) else np.zeros(0, U64)


def _answers(bits: pa.Table, level: int, column: str, n: int) -> np.ndarray:
    """The bits that came back for a level, in order of buckets."""
    mine = bits.filter(pa.compute.equal(bits["level"], level)).sort_by("bucket")
    parts = [np.frombuffer(x, np.uint8) for x in mine[column].to_pylist()]
    return np.concatenate(parts).astype(bool)[:n] if parts else np.zeros(n, bool)


def _packed(flags: np.ndarray) -> bytes:
    return flags.astype(np.uint8).tobytes()


_ENTRY = np.dtype([("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("at", "<i8")])


def repeats(
    docs: DataFrame, length: int = 20, first: int = 10, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Words of each document that lie in a window of `length` words that started earlier.

    Gives one row per row of `docs`: doc_id, n_words, n_removed, removed (first word and end of each
    removed run, in turn), kept_sha256 (of the kept words, joined by one space). Earlier is a
    smaller doc_id (NULL last), or an earlier start in the same document. `length` is `first` times a
    power of 2. NULL and empty texts have no words. Rows that agree in id and text are one document
    and get the same answer; rows that share only the id come in order of their texts.
    """
    lengths = [first]
    while lengths[-1] < length:
        lengths.append(lengths[-1] * 2)
    if lengths[-1] != length:
        raise ValueError("length must be first times a power of 2")
    rows, size = text_total(docs, text)
    homes = parts_for(size + 64 * rows, HOME_BYTES)
    # A word takes some six bytes of text, a window starts at most words.
    buckets = parts_for(size / 6, BUCKET_WINDOWS)
    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(homes)).alias("home"), F.col(doc_id).cast("long").alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    spark = docs.sparkSession
    known = spark.createDataFrame([], _BITS)
    last = len(lengths) - 1

    def ship(level: int):
        def shipped(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
            home = _Home(table)
            at, hashes = _at_level(home, lengths[level], _survivors(home, bits, lengths, level))
            unique, where = np.unique(hashes, return_index=True)
            if level == last:
                _, second = _at_level(home, lengths[level], at, SECOND_STEP)
                entries = np.zeros(len(unique), _ENTRY)
                start = at[where]
                row = home.row[start]
                entries["h"], entries["g"], entries["id"] = unique, second[where], home.ids[row]
                entries["at"] = home.sub[row] << 40 | (start - home.words.first[row])
            else:
                entries = (unique & U64(0xFFFFFFFF)).astype(np.uint32)
            runs = _cut_by(_bucket(unique, buckets))
            return pa.table({
                "bucket": pa.array([r[0] for r in runs], pa.int64()), "home": pa.array([key[0].as_py()] * len(runs), pa.int64()),
                "entries": pa.array([entries[a:b].tobytes() for _, a, b in runs], pa.binary()),
            })

        return shipped

    def judge(level: int):
        def judged(key: tuple, table: pa.Table) -> pa.Table:
            kind = _ENTRY if level == last else np.dtype(np.uint32)
            parts = [np.frombuffer(x, kind) for x in table["entries"].to_pylist()]
            entries = np.concatenate(parts)
            if level == last:
                order = np.lexsort((entries["at"], entries["id"], entries["g"], entries["h"]))
                h, g = entries["h"][order], entries["g"][order]
                same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
            else:
                order = np.argsort(entries, kind="stable")
                same = entries[order][1:] == entries[order][:-1]
            later, repeated = np.zeros(len(entries), bool), np.zeros(len(entries), bool)
            later[order[1:]] = same
            repeated[order[1:]] |= same
            repeated[order[:-1]] |= same
            ends = np.cumsum([len(p) for p in parts])
            return pa.table({
                "home": table["home"].cast(pa.int64()), "level": pa.array([level] * len(parts), pa.int32()),
                "bucket": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                "bits": pa.array([_packed(repeated[b - len(p):b]) for p, b in zip(parts, ends, strict=True)], pa.binary()),
                "more": pa.array([_packed(later[b - len(p):b]) if level == last else b"" for p, b in zip(parts, ends, strict=True)], pa.binary()),
            })

        return judged

    for level in range(len(lengths)):
        shipped = dealt.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(ship(level), _SHIPPED) if level else \
            dealt.groupBy("home").applyInArrow(_alone(ship(0)), _SHIPPED)
        answers = shipped.groupBy("bucket").applyInArrow(judge(level), _BITS)
        known = known.union(answers)

    def finish(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        home = _Home(table)
        at, hashes = _at_level(home, length, _survivors(home, bits, lengths, last))
        _, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        later = _answers(bits, last, "more", len(where))[inverse]
        # In its home only the first of equal windows was shipped; the rest are later anyway.
        later[np.arange(len(at)) != where[inverse]] = True
        edge = np.zeros(len(home.words.hashes) + 1, np.int64)
        np.add.at(edge, at[later], 1)
        np.add.at(edge, at[later] + length, -1)
        return _result(home, np.cumsum(edge)[:-1] > 0)

    return dealt.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, removed array<int>, kept_sha256 string")


def _alone(shipped):
    empty = pa.table({"home": pa.array([], pa.int64()), "level": pa.array([], pa.int32()), "bucket": pa.array([], pa.int64()), "bits": pa.array([], pa.binary()), "more": pa.array([], pa.binary())})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return shipped(key, table, empty)

    return run


def _result(home: _Home, removed: np.ndarray) -> pa.Table:
    found = home.words
    # A kept word keeps its bytes and, in the same text, one separator after it, written as a space.
    mark = np.zeros(len(found.flat) + 1, np.int8)
    starts, ends = found.starts[~removed], found.ends[~removed]
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends, -1)
    kept = np.cumsum(mark[:-1]) > 0
    after = ends[ends < len(found.flat)]
    kept[after[~SPACED.in_word[found.flat[after]]]] = True
    flat = np.where(SPACED.in_word[found.flat], found.flat, 0x20)
    spans, hashes, counts = [], [], []
    first = found.first.tolist()
    for row in range(len(home.ids)):
        a, b = first[row], first[row + 1]
        if home.copy[row]:
            spans.append(spans[-1])
            hashes.append(hashes[-1])
            counts.append(counts[-1])
            continue
        gone = removed[a:b]
        counts.append(int(gone.sum()))
        spans.append(np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).astype(np.int32) if counts[-1] else [])
        if a < b:
            lo, hi = found.starts[a], found.ends[b - 1]
            text = flat[lo:hi][kept[lo:hi]].tobytes()
            hashes.append(hashlib.sha256(text.removesuffix(b" ")).hexdigest())
        else:
            hashes.append(hashlib.sha256(b"").hexdigest())
    return pa.table({
        "doc_id": home.table["id"].cast(pa.int64()), "n_words": pa.array(found.counts(), pa.int64()), "n_removed": pa.array(counts, pa.int64()),
        "removed": pa.array(spans, pa.list_(pa.int32())), "kept_sha256": pa.array(hashes, pa.string()),
    })
