"""Removal of long byte strings that occur elsewhere, from merged Burrows-Wheeler transforms.

1. Sieve. In every run of WINDOW k-grams the one with the smallest hash is an anchor. Equal strings have equal
   anchors, so a string of `length` bytes can only repeat if all anchors inside it do. Texts are
   dealt to homes; a home ships its distinct anchors, and bits come back.
2. Filter. A home ships 32 bits of the hash of each distinct string the sieve left; what has no like hash anywhere
   leaves. This only spares work: nothing is removed by hashes.
3. Merge. What is left are stretches of documents. Each is a shard with its own
   transform: the bytes before each of its suffixes. All shards start in one
   interleave that knows nothing, and each refinement sorts it, stably, by the symbol before its
   suffixes: an interleave right to depth k becomes one right to that much more. Its own blocks are the symbols of the
   next refinement, so ten of them reach 400 bytes. Blocks of suffixes with one prefix are kept along, so their common prefixes are known; suffixes alone in their
   block are settled and leave. What stays to depth `length` are the repeated intervals.
   First a home merges its own stretches. Then one string of each of its classes goes to where strings with the same
   least anchor meet, whatever their homes: neighbours with one anchor as one stretch. There the same merge decides.
   Anchors in many homes come last in that choice, so that a common line does not gather what stands around it.

Equal texts are one text with a count, from the map side on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from benchloom.llm.arrays import BYTE_HASH, U64, mix, pieces, powers, text_bytes
from benchloom.llm.frames import fresh, parts_for

LENGTH = 400
GRAM, WINDOW = 24, 40
HOME_BYTES = 4 << 20
# Bytes of stretches that are merged at a time; those of one anchor stay together.
MERGE_BYTES = 1 << 20
# An anchor in more homes than this is common.
COMMON_HOMES = 64
BUCKET_ENTRIES = 1_500_000

_STEP = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MOST = U64(0xFFFFFFFFFFFFFFFF)
_PIECE = 128 << 10
_BITS = "home long, level int, bucket long, bits binary"
_SHIPPED = "bucket long, home long, entries binary"
_STRETCHES = "bucket long, home long, anchors binary, begins binary, sizes binary, marks binary, bytes binary"


def _sliding(values: np.ndarray, width: int, best: np.ufunc, fill: np.uint64) -> np.ndarray:
    """best over values[p:p + width] for every p; beyond the end it sees `fill`."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        moved = np.full(len(values), fill, U64)
        moved[:len(values) - step] = out[step:] if step < len(values) else out[:0]
        out = best(out, moved)
        have += step
    return out


class _Piece:
    """Some texts of a home, few enough that their arrays stay in the processor's cache.

    A home has many pieces at hand, so a piece keeps its bytes, its anchors and runs of k-grams only; the rest is made when asked for.
    """

    def __init__(self, texts: pa.Array, copies: np.ndarray, length: int, step: np.ndarray, back: np.ndarray) -> None:
        self.length, self.step, self.back = length, step, back
        self.flat, self.bounds = text_bytes(texts)
        n = len(self.flat)
        place, end, sums = np.arange(n), self.end, self.sums
        grams = np.full(n, _MOST, U64)
        inside = place + GRAM <= end
        last = max(n - GRAM + 1, 0)
        grams[:last] = mix((sums[GRAM:GRAM + last] - sums[:last]) * self.back[:last])
        grams[~inside] = _MOST
        # The smallest hash of each run of WINDOW k-grams, and the k-grams that are it in some run.
        least = _sliding(grams, WINDOW, np.minimum, _MOST)
        top = _sliding(np.where(self.whole, least, U64(0))[::-1], WINDOW, np.maximum, U64(0))[::-1]
        chosen = np.flatnonzero((top == grams) & inside)
        self.anchors = grams[chosen]
        self.copied = np.repeat(copies > 1, np.diff(self.bounds))[chosen]
        # Where that smallest hash changes, and to what.
        self.runs = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1]))).astype(np.int32)
        self.least = least[self.runs]

    @property
    def end(self) -> np.ndarray:
        """Where the text of each byte ends."""
        return np.repeat(self.bounds[1:].astype(np.int32), np.diff(self.bounds))

    @property
    def whole(self) -> np.ndarray:
        """Where a run of WINDOW k-grams fits into its text."""
        return np.arange(len(self.flat)) + GRAM + WINDOW - 1 <= self.end

    @property
    def sums(self) -> np.ndarray:
        """Sums whose differences hash strings."""
        return np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_HASH[self.flat] * self.step[:len(self.flat)])))

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        sums = self.sums
        return mix((sums[at + width] - sums[at]) * self.back[at])

    def _spread(self, values: np.ndarray) -> np.ndarray:
        """A value of each run at each of its places."""
        return np.repeat(values, np.diff(np.concatenate((self.runs, [len(self.flat)]))))

    def candidates(self, values: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Starts of strings all of whose anchors repeat."""
        n = len(self.flat)
        where = np.minimum(np.searchsorted(values, self.least), max(len(values) - 1, 0))
        good = repeated[where] & (values[where] == self.least) if len(values) else np.zeros(len(self.runs), bool)
        bad = self._spread(~good) & self.whole
        total = np.concatenate(([0], np.cumsum(bad, dtype=np.int32)))
        fits = np.flatnonzero(np.arange(n) + self.length <= self.end)
        return fits[total[fits + self.length - GRAM - WINDOW + 2] == total[fits]]

    def dealt_by(self, at: np.ndarray, values: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The least anchor inside each string that starts at `at`; common ones come after all others."""
        where = np.minimum(np.searchsorted(values, self.least), max(len(values) - 1, 0))
        last = (common[where] & (values[where] == self.least)).astype(U64) << U64(63)
        ranked = self._spread(last | self.least >> U64(1))
        return _sliding(ranked, self.length - GRAM - WINDOW + 2, np.minimum, _MOST)[at]


class _Home:
    """Texts of one home in order of their keys, with their anchors."""

    def __init__(self, table: pa.Table, length: int) -> None:
        table = table.take(pc.sort_indices(table, [("key", "ascending")]))
        self.keys, self.copies, self.length = table["key"], table["n"].to_numpy(), length
        texts = table["text"].combine_chunks()
        self.ranges = list(pieces(texts, _PIECE))
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
        longest = max((int(sizes[b] - sizes[a]) for a, b in self.ranges), default=0)
        step, back = powers(_STEP, longest), powers(_BACK, longest)
        self.pieces = [_Piece(texts.slice(a, b - a), self.copies[a:b], length, step, back) for a, b in self.ranges]
        anchors = np.concatenate([p.anchors for p in self.pieces])
        self.values, n_each = np.unique(anchors, return_counts=True)
        self.often = (n_each > 1) | np.isin(self.values, anchors[np.concatenate([p.copied for p in self.pieces])])

    def left(self, repeated: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """What the sieve leaves: starts per piece, and the distinct hashes of their strings with the place of each."""
        starts = [p.candidates(self.values, repeated) for p in self.pieces]
        hashes = np.concatenate([p.hashes(at, self.length) for p, at in zip(self.pieces, starts, strict=True)])
        return starts, *np.unique(hashes, return_inverse=True)


def _stretches(home: _Home, starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that candidate strings cover, stretch after stretch; the ends of the stretches; each start's place."""
    flats, ends, places, have = [], [], [], 0
    for piece, at in zip(home.pieces, starts, strict=True):
        if len(at):
            # A new stretch begins where the last start's string has ended, or in another text.
            text_end = piece.end[at]
            first = np.flatnonzero(np.concatenate(([True], (at[1:] > at[:-1] + home.length) | (text_end[1:] != text_end[:-1]))))
            begin, end = at[first], at[np.concatenate((first[1:], [len(at)])) - 1] + home.length
            sizes = end - begin
            base = have + np.cumsum(sizes) - sizes
            which = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(at)]))))
            flats += [piece.flat[a:b] for a, b in zip(begin, end, strict=True)]
            places.append(at - begin[which] + base[which])
            ends.append(base + sizes)
            have += int(sizes.sum())
    none = np.zeros(0, np.int64)
    return (np.concatenate(flats) if flats else np.zeros(0, np.uint8)), (np.concatenate(ends) if ends else none), (np.concatenate(places) if places else none)


def _steps(length: int) -> list[int]:
    """By how many bytes each refinement deepens the interleave: pairs first, then doubling, then what is left of `length`."""
    top = 1 << (length.bit_length() - 1)
    doubling = [1 << k for k in range(1, top.bit_length() - 1)]
    return [2, *doubling, *(1 << k for k in reversed(range(top.bit_length() - 1)) if (length - top) >> k & 1)]


def repeated_classes(flat: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Numbers the classes of equal strings of `length` bytes in the given stretches, at each start; 0 for a string that occurs once.

    Every stretch is a shard. The interleave begins in shard order; a refinement goes from each suffix to the one that is a
    symbol longer and sorts by that symbol, stably, which keeps the order of what follows. Symbols are two bytes at first. Blocks
    of an interleave right to depth d rank all strings of d bytes that occur twice, so they are the symbols of d bytes from there
    on, and a suffix preceded by another string is alone.
    """
    n = len(flat)
    found = np.zeros(n, np.int32)
    if n < 2:
        return found
    sizes = np.diff(np.concatenate(([0], ends)))
    begin_of = np.repeat(ends - sizes, sizes).astype(np.int32)
    pairs = np.zeros(n, np.uint16)
    pairs[:-1] = flat[:-1].astype(np.uint16) << 8 | flat[1:]
    ranks = {2: pairs}
    rows = np.arange(n, dtype=np.int32)
    rows = rows[rows + 2 <= np.repeat(ends, sizes)]
    block = np.zeros(len(rows), np.int32)
    steps, depth = _steps(length), 0
    for at, step in enumerate(steps):
        before = ranks[step][rows]
        # By the low and, where there are that many symbols, by the high half: both sorts are stable and by two bytes.
        order = np.argsort(before.astype(np.uint16), kind="stable")
        if step > 2 and len(before) and before.max() >> 16:
            order = order[np.argsort((before >> 16).astype(np.uint16)[order], kind="stable")]
        rows, before, block = rows[order], before[order], block[order]
        new = np.ones(len(rows), bool)
        new[1:] = (before[1:] != before[:-1]) | (block[1:] != block[:-1])
        # Alone: a new block starts here and right after.
        several = ~(new & np.concatenate((new[1:], [True])))
        block = np.cumsum(new, dtype=np.int32)[several]
        rows = rows[several]
        depth += step
        later = steps[at + 1:]
        if depth >= length or not len(rows):
            break
        ranks = {w: r for w, r in ranks.items() if w in later}
        if depth in later:
            ranks[depth] = np.zeros(n, np.int32)
            ranks[depth][rows] = block
        # Suffixes at the front of their shard have no bytes before them.
        ahead = rows - later[0]
        alive = ahead >= begin_of[rows]
        if later[0] > 2:
            alive &= ranks[later[0]][np.maximum(ahead, 0)] > 0
        rows, block = ahead[alive], block[alive]
    found[rows] = block
    return found


def _runs(unique: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    bucket = ((unique >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True)]


def _judge(level: int):
    """In how many homes each entry of a bucket is: 0 for one, 1 for several, 2 for more than COMMON_HOMES."""
    def judged(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table["entries"].to_pylist()]
        entries = np.concatenate(parts)
        order = np.argsort(entries, kind="stable")
        group = np.cumsum(np.concatenate(([False], entries[order][1:] != entries[order][:-1])))
        counts = np.bincount(group)
        answer = np.zeros(len(entries), np.uint8)
        answer[order] = ((counts > 1).astype(np.uint8) + (counts > COMMON_HOMES))[group]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({
            "home": table["home"].cast(pa.int64()), "level": pa.array([level] * len(parts), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int64()),
            "bits": pa.array([answer[b - len(p):b].tobytes() for p, b in zip(parts, ends, strict=True)], pa.binary()),
        })

    return judged


def _intervals(at: np.ndarray) -> np.ndarray:
    """First and last of each run of neighbours in sorted numbers."""
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1))) if len(at) else np.zeros(0, int)
    return np.column_stack((at[new], at[np.concatenate((new[1:], [len(at)])) - 1] if len(at) else at)).astype(np.int64).ravel()


def _stretches_of(home: _Home, starts: list[np.ndarray], common: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of _STRETCHES but the home: the strings at `starts`, neighbours with one least anchor as one stretch."""
    anchors, begins, sizes, texts, marks, have = [], [], [], [], [], 0
    for piece, at in zip(home.pieces, starts, strict=True):
        if len(at):
            least = piece.dealt_by(at, home.values, common)
            text_end = piece.end[at]
            new = (least[1:] != least[:-1]) | (at[1:] > at[:-1] + home.length) | (text_end[1:] != text_end[:-1])
            first = np.flatnonzero(np.concatenate(([True], new)))
            to = np.concatenate((first[1:], [len(at)]))
            ends = at[to - 1] + home.length
            anchors.append(least[first])
            begins.append(at[first] + have)
            sizes.append(ends - at[first])
            for a, b, i, k in zip(at[first], ends, first, to, strict=True):
                texts.append(piece.flat[a:b])
                mark = np.zeros(b - a, np.uint8)
                mark[at[i:k] - a] = 1
                marks.append(mark)
        have += len(piece.flat)
    if not anchors:
        return []
    anchors, begins, sizes = np.concatenate(anchors), np.concatenate(begins), np.concatenate(sizes)
    dealt = mix(anchors)
    order = np.argsort(dealt, kind="stable")
    return [
        (bucket, anchors[order[a:b]].tobytes(), begins[order[a:b]].astype(np.int64).tobytes(), sizes[order[a:b]].astype(np.int64).tobytes(),
         np.packbits(np.concatenate([marks[i] for i in order[a:b]])).tobytes(), np.concatenate([texts[i] for i in order[a:b]]).tobytes())
        for bucket, a, b in _runs(dealt[order], buckets)
    ]


def _merge(length: int):
    """Which marked strings of a bucket's stretches occur twice, as intervals of starts in each home. What a home found itself passes."""
    def merged(key: tuple, table: pa.Table) -> pa.Table:
        bucket, homes = key[0].as_py(), table["home"].to_numpy()
        if bucket < 0:
            return pa.table({"home": table["home"].cast(pa.int64()), "intervals": table["bytes"].cast(pa.binary())})
        rows = table.select(["anchors", "begins", "sizes", "marks", "bytes"]).to_pylist()
        anchors = [np.frombuffer(r["anchors"], U64) for r in rows]
        begins = np.concatenate([np.frombuffer(r["begins"], np.int64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in rows])
        of = np.repeat(homes, [len(a) for a in anchors])
        flat = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows])
        mark = np.concatenate([np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=len(r["bytes"])) for r in rows]).astype(bool)
        at = np.cumsum(sizes) - sizes
        anchors = np.concatenate(anchors)
        order = np.argsort(anchors, kind="stable")
        total = np.cumsum(sizes[order])
        last = np.flatnonzero(np.concatenate((anchors[order][1:] != anchors[order][:-1], [True]))) + 1
        found, lo = [np.zeros((0, 2), np.int64)], 0
        while lo < len(order):
            # As many whole groups as fit, at least one.
            fits = np.searchsorted(total[last - 1], (total[lo - 1] if lo else 0) + MERGE_BYTES, side="right")
            hi = int(max(last[max(fits - 1, 0)], last[np.searchsorted(last, lo, side="right")]))
            mine = order[lo:hi]
            lo = hi
            if len(mine) < 2:
                continue
            bytes_of = np.concatenate([flat[at[i]:at[i] + sizes[i]] for i in mine])
            marked = np.flatnonzero(np.concatenate([mark[at[i]:at[i] + sizes[i]] for i in mine]))
            ends = np.cumsum(sizes[mine])
            classes = repeated_classes(bytes_of, ends, length)[marked]
            twice = marked[(np.bincount(classes, minlength=1)[classes] > 1) & (classes > 0)]
            run = np.searchsorted(ends, twice, side="right")
            found.append(np.column_stack((of[mine[run]], twice - (ends - sizes[mine])[run] + begins[mine[run]])))
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        named, first = np.unique(found[:, 0], return_index=True)
        return pa.table({
            "home": pa.array(named, pa.int64()),
            "intervals": pa.array([_intervals(f).tobytes() for f in np.split(found[:, 1], first[1:])][:len(named)], pa.binary()),
        })

    return merged


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = pc.value_counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["text", "n"])


def repeated_bytes(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Distinct texts of at least `length` bytes (key, n_bytes, n_removed, n_spans, spans, kept_sha256).

    `key` is the SHA-256 of the text. A byte is removed if it is covered by a string of `length` bytes that also starts
    elsewhere, in the same text or another row; overlaps count. `spans` holds start and end of each removed run.
    """
    if length % 2 or length < GRAM + WINDOW:
        raise ValueError(f"length must be even and at least {GRAM + WINDOW}")
    whole = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= length)
    size = whole.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    homes, buckets = parts_for(size, HOME_BYTES), parts_for(size / 8, BUCKET_ENTRIES)
    dealt = (
        whole.mapInArrow(_collapse, "text string, n long")
        .withColumn("key", F.sha2(F.col("text").cast("binary"), 256)).withColumn("home", F.pmod(F.xxhash64("key"), F.lit(homes)))
        .repartition("home").groupBy("home", "key", "text").agg(F.sum("n").alias("n"))
    )

    def ship_anchors(key: tuple, table: pa.Table) -> pa.Table:
        home = _Home(table, length)
        return _entries(key, home.values)

    def _entries(key: tuple, unique: np.ndarray) -> pa.Table:
        runs, entries = _runs(unique, buckets), (unique & U64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({
            "bucket": pa.array([r[0] for r in runs], pa.int64()), "home": pa.array([key[0].as_py()] * len(runs), pa.int64()),
            "entries": pa.array([entries[a:b].tobytes() for _, a, b in runs], pa.binary()),
        })

    def left(table: pa.Table, bits: pa.Table) -> tuple[_Home, list[np.ndarray], np.ndarray, np.ndarray]:
        home = _Home(table, length)
        return home, *home.left(home.often | (_flags(bits, 0, len(home.values)) > 0))

    def ship_strings(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        return _entries(key, left(table, bits)[2])

    def ship_stretches(key: tuple, table: pa.Table, bits: pa.Table) -> pa.Table:
        home, starts, unique, inverse = left(table, bits)
        elsewhere = (_flags(bits, 1, len(unique)) > 0)[inverse]
        several = (np.bincount(inverse, minlength=len(unique)) > 1)[inverse]
        bounds = np.cumsum([len(at) for at in starts])[:-1]

        def chosen(marks: np.ndarray) -> list[np.ndarray]:
            return [at[m] for at, m in zip(starts, np.split(marks, bounds), strict=True)]

        flat, ends, places = _stretches(home, chosen(several))
        classes = np.zeros(len(inverse), np.int32)
        classes[several] = repeated_classes(flat, ends, length)[places]
        # One string speaks for its class in the other homes; the class itself is settled.
        speaks, settled = elsewhere & (classes == 0), np.flatnonzero(elsewhere & (classes > 0))
        speaks[settled[np.unique(classes[settled], return_index=True)[1]]] = True
        rows = _stretches_of(home, chosen(speaks), _flags(bits, 0, len(home.values)) > 1, buckets)
        offsets = np.concatenate(([0], np.cumsum([len(p.flat) for p in home.pieces])))
        own = np.concatenate([at + o for at, o in zip(chosen(classes > 0), offsets, strict=False)])
        rows.append((-1 - key[0].as_py(), b"", b"", b"", b"", _intervals(own).tobytes()))
        found = list(zip(*rows, strict=True))
        return pa.table({
            "bucket": pa.array(found[0], pa.int64()), "home": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            **{name: pa.array(values, pa.binary()) for name, values in zip(("anchors", "begins", "sizes", "marks", "bytes"), found[1:], strict=True)},
        })

    def finish(key: tuple, table: pa.Table, repeated: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("key", "ascending")]))
        copies, texts = table["n"].to_numpy(), table["text"].combine_chunks()
        ranges = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in repeated["intervals"].to_pylist()]])
        firsts, lasts = ranges[::2], ranges[1::2]
        order = np.argsort(firsts, kind="stable")
        # No two intervals share a start, so the lasts are in the same order.
        firsts, lasts = firsts[order], lasts[order] + length
        spans, hashes, counts, sizes, used = [], [], [], [], 0
        for lo, hi in pieces(texts, _PIECE):
            flat, bounds = text_bytes(texts.slice(lo, hi - lo))
            a, b = np.searchsorted(firsts, used), np.searchsorted(firsts, used + len(flat))
            edge = np.zeros(len(flat) + 1, np.int32)
            np.add.at(edge, firsts[a:b] - used, 1)
            np.add.at(edge, lasts[a:b] - used, -1)
            used += len(flat)
            removed = np.cumsum(edge[:-1]) > 0
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                out = removed[a:b] if copies[lo + row] == 1 else np.ones(b - a, bool)
                counts.append(int(out.sum()))
                sizes.append(int(b - a))
                spans.append(np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0])))).tolist() if counts[-1] else [])
                hashes.append(hashlib.sha256(flat[a:b][~out].tobytes() if counts[-1] else flat[a:b].tobytes()).hexdigest())
        return pa.table({
            "key": table["key"].cast(pa.string()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(counts, pa.int64()),
            "n_spans": pa.array([len(s) // 2 for s in spans], pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept_sha256": pa.array(hashes, pa.string()),
        })

    by_home = dealt.groupBy("home")
    anchored = by_home.applyInArrow(ship_anchors, _SHIPPED).groupBy("bucket").applyInArrow(_judge(0), _BITS)
    found = by_home.cogroup(anchored.groupBy("home")).applyInArrow(ship_strings, _SHIPPED).groupBy("bucket").applyInArrow(_judge(1), _BITS)
    merged = by_home.cogroup(anchored.union(found).groupBy("home")).applyInArrow(ship_stretches, _STRETCHES).groupBy("bucket").applyInArrow(
        _merge(length), "home long, intervals binary")
    return by_home.cogroup(merged.groupBy("home")).applyInArrow(
        finish, "key string, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string")


def _flags(bits: pa.Table, level: int, n: int) -> np.ndarray:
    """The answers of a level in the order the home shipped in, by bucket."""
    mine = bits.filter(pc.equal(bits["level"], level)).sort_by("bucket")
    parts = [np.frombuffer(x, np.uint8) for x in mine["bits"].to_pylist()]
    return np.concatenate(parts)[:n] if parts else np.zeros(n, np.uint8)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Removed bytes of each document: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256; one row per row.

    Repeated rows are separate documents: what is long enough in them is removed from both. A NULL text is
    empty; empty texts and texts shorter than `length` stay whole. A NULL doc_id is kept. An
    empty table gives an empty result.
    """
    found = repeated_bytes(docs, text, length)
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(
        F.col(doc_id).alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("own"))
    removed = found.where("n_removed > 0").select("key", "n_removed", "n_spans", "spans", "kept_sha256")
    zero = F.lit(0).cast("long")
    return own.join(removed, F.col("own") == F.col("key"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with the repeated bytes cut out of the texts, in the columns they came with.

    Bytes that a cut leaves of a broken character are dropped, as a text must stay valid. Texts that
    do not change are not touched: a NULL stays NULL.
    """
    spans, key = fresh("spans", docs.columns), fresh("own_key", docs.columns)
    other = fresh("found_key", docs.columns)
    removed = repeated_bytes(docs, text, length).where("n_removed > 0").select(F.col("key").alias(other), F.col("spans").alias(spans))
    marked = docs.withColumn(key, F.sha2(F.col(text).cast("binary"), 256))
    joined = marked.join(removed, F.col(key) == F.col(other), "left").select(*docs.columns, spans)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            for row, pairs in enumerate(batch.column(batch.schema.get_field_index(spans)).to_pylist()):
                if pairs:
                    raw, kept, done = texts[row].encode(), [], 0
                    for a, b in zip(pairs[::2], pairs[1::2], strict=True):
                        kept.append(raw[done:a])
                        done = b
                    texts[row] = b"".join([*kept, raw[done:]]).decode(errors="ignore")
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name != spans}
            columns[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(cut_out, docs.schema)
