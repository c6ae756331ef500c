"""Near duplicates by weighted MinHash: consistent weighted samples of TF-IDF shingles, in bands, verified.

A document is the weighted set of its shingles of five words, the weight being the count in the
document times the inverse document frequency sqrt(log(1 + documents / df)). Without `common` every shingle has its own
document frequency: texts are dealt to homes, a home ships its distinct shingles to buckets, and their frequencies come back.
There documents / df counts as `RARE` at most. Else what near copies changed would weigh the more the larger the table is, beside what a group of
them shares, and no large group would hold together; boilerplate of 1 in `RARE` documents and more still weighs less than other text.
With it, shingles in fewer than 1 of `common` documents all have one weight, and only the frequent ones are counted; that keeps
large groups of near copies together, which lose links to their own frequency. Improved consistent weighted
sampling draws from each set so that two sets agree in a draw with the probability of their
weighted Jaccard similarity. Documents that agree in a whole band are candidates, and each
candidate link is verified on the texts.

Texts with the same words are one class from the start and take part once. In a bucket, one
leader is compared with all others; that settles most buckets. Where a bucket still
holds several classes, its sets are packed into blocks, and each tile of two blocks is one product of
matrices. So classes lose no link that a bucket shows, and no pair becomes a row but those with a leader.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from benchloom.llm.arrays import U64, Words, _ALL, _alphabet, mix, pieces, words
from benchloom.llm.components import components
from benchloom.llm.frames import fresh, parts_for, text_total
from benchloom.storage import Scratch, cut

SHINGLE = 5
SIMILAR = 0.8
BANDS, BAND_ROWS = 16, 4
COMMON = 8
# Documents, for one with a shingle, from which on the shingle's weight grows no more.
RARE = 128
# Hash slots in which shingles are counted to find the frequent ones, and how many go in one row.
SLOTS, SLOT_BLOCK = 1 << 19, 1 << 13
# Bits of a shingle's hash that pick its random numbers; fewer where every weight needs them.
_TABLE_BITS, _TABLE_BITS_EACH = 16, 15
# Bytes of text in a home, and shingles in a bucket.
HOME_BYTES, BUCKET_SHINGLES = 2 << 20, 750_000
# Bytes of text whose words are at hand at a time; their places take far more.
_PIECE = 256 << 10
# Documents in one block of a bucket that has to be compared in full, and columns of one product.
BLOCK, COLUMNS = 64, 4096
# Bytes of tiles that one task compares.
TASK_BYTES = 8 << 20

# [^\x20\x09-\x0D]+ after A-Z became a-z
_WORDS = _alphabet(~np.isin(_ALL, [0x20, *range(0x09, 0x0E)]), lower=True)


def shingles(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the distinct shingles of each text: text number, hash, count. Ascending in both.

    A text of fewer than five words is one shingle; one without words has none.
    """
    found = words(column, _WORDS)
    at, hashes = found.windows(SHINGLE)
    row = found.text_of()[at] if len(at) else np.zeros(0, np.int64)
    counts = found.counts()
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            start, whole = found.windows(n)
            place = np.searchsorted(start, found.first[short])
            row, hashes = np.concatenate((row, short)), np.concatenate((hashes, whole[place]))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return found, row[first], hashes[first], np.diff(np.concatenate((first, [len(row)])))


def _content(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the word sequence of each text; 0 and 0 without words."""
    out = []
    n = len(found.first) - 1
    place = np.arange(len(found.hashes)) - np.repeat(found.first[:-1], found.counts())
    filled = np.flatnonzero(found.counts())
    for seed in (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)):
        value = np.zeros(n, U64)
        if len(filled):
            spread = mix(found.hashes ^ mix((place.astype(U64) + U64(1)) * seed))
            value[filled] = np.add.reduceat(spread, found.first[:-1][filled])
        out.append(value.view(np.int64))
    return out[0], out[1]


@dataclass
class Weights:
    """Inverse document frequencies: those of the frequent shingles, and the one of all others.

    With `total` documents each shingle comes with its document frequency, and `other` is the weight of those in one document and of all in no more than 1 of `RARE`.
    """

    frequent: np.ndarray
    idf: np.ndarray
    other: float
    total: int | None = None

    def of(self, hashes: np.ndarray, counts: np.ndarray, frequencies: np.ndarray | None = None) -> np.ndarray:
        if self.total is not None:
            share = self.total / frequencies
            idf = np.sqrt(np.log1p(np.minimum(share, RARE)))
            idf[(frequencies == 1) | (share >= RARE)] = self.other
            return idf * counts
        weight = np.full(len(hashes), self.other)
        if len(self.frequent) and len(hashes):
            place = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
            known = self.frequent[place] == hashes
            weight[known] = self.idf[place[known]]
        return weight * counts


def document_frequencies(docs: DataFrame, text: str, common: int = COMMON) -> Weights:
    """Weights from the document frequencies of the shingles in at least 1 of `common` documents; all others weigh alike.

    A first pass counts shingles in hash slots; only a slot with documents enough can hold a frequent
    shingle. A second pass counts the shingles of such slots one by one. The share that makes a shingle
    frequent is fixed, so their number is bounded by `common` times the mean number of shingles, whatever the data size.
    """
    total = docs.count()
    least = max(total / common, 2.0)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for lo, hi in pieces(whole.column("text")):
                hashes = shingles(whole.column("text").slice(lo, hi - lo))[2]
                counts += np.bincount((hashes >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64), minlength=SLOTS)
        blocks = counts.reshape(-1, SLOT_BLOCK)
        filled = np.flatnonzero(blocks.any(axis=1))
        salt = int(counts.sum()) % 64
        yield pa.RecordBatch.from_arrays([
            pa.array(filled, pa.int64()), pa.array(np.full(len(filled), salt)), pa.array([blocks[b].tobytes() for b in filled], pa.binary()),
        ], names=["block", "salt", "counts"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        total_counts = np.sum([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()], axis=0)
        salts = [key[1].as_py() if len(key) > 1 else 0]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "salt": pa.array(salts, pa.int64()), "counts": pa.array([total_counts.tobytes()], pa.binary())})

    shape = "block long, salt long, counts binary"
    texts = docs.select(F.col(text).alias("text"))
    partial = texts.mapInArrow(slots, shape).groupBy("block", "salt").applyInArrow(summed, shape)

    def heavy(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.frombuffer(summed(key, table)["counts"][0].as_py(), np.int64)
        return pa.table({"slot": pa.array(np.flatnonzero(counts >= least) + key[0].as_py() * SLOT_BLOCK, pa.int64())})

    busy = np.sort(partial.groupBy("block").applyInArrow(heavy, "slot long").toPandas()["slot"].to_numpy(np.int64))
    rare = float(np.sqrt(np.log1p(common)))
    if not len(busy):
        return Weights(np.zeros(0, U64), np.zeros(0), rare)
    is_busy = np.zeros(SLOTS, bool)
    is_busy[busy] = True

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found = []
            for lo, hi in pieces(whole.column("text")):
                hashes = shingles(whole.column("text").slice(lo, hi - lo))[2]
                found.append(hashes[is_busy[(hashes >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)]])
            unique, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counts = texts.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    hashes = counts["h"].to_numpy(np.int64).view(U64)
    order = np.argsort(hashes)
    return Weights(hashes[order], np.sqrt(np.log1p(total / counts["n"].to_numpy(float)[order])), rare)


class Sampler:
    """Improved consistent weighted sampling, with its random numbers in tables.

    Draw h of an element uses the random numbers of the entry that the element's hash picks. For the weight of
    all rare shingles, the logarithm that the sample minimizes is kept for every entry, as
    whole numbers above the low bits of the hash: one minimum gives the sample's element too. Where `each` shingle has a weight of
    its own, the random numbers are kept as well, in half as many entries of half the precision.
    """

    def __init__(self, other: float, each: bool = False) -> None:
        self.bits = _TABLE_BITS_EACH if each else _TABLE_BITS
        n, size = BANDS * BAND_ROWS, 1 << self.bits
        self.odd = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        self.other = other
        every = np.arange(size, dtype=U64)
        self.drawn = [tuple(x.astype(np.float32) for x in self._draws(h, every)) for h in range(n)] if each else None
        usual = [self._key(self.log_a(h, every, np.full(size, np.log(other)))) >> U64(32) for h in range(n)]
        self.usual = np.array(usual).astype(np.uint32)

    @staticmethod
    def _uniform(which: int, h: int, entry: np.ndarray) -> np.ndarray:
        bits = mix(mix(entry + U64((which << 40) + (h << _TABLE_BITS))) ^ U64(which))
        return ((bits >> U64(11)).astype(np.float64) + 0.5) / 2.0**53

    def _draws(self, h: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = [self._uniform(which, h, entry) for which in range(1, 6)]
        return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]

    def log_a(self, h: int, entry: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
        """ln c - r (t - beta) - r of the elements with these entries, where t = floor(ln weight / r + beta)."""
        if self.drawn is None:
            r, log_c, beta = self._draws(h, entry)
        else:
            r, log_c, beta = (x[entry] for x in self.drawn[h])
        t = np.floor(log_weight.astype(r.dtype, copy=False) / r + beta)
        return log_c - r * (t - beta) - r

    @staticmethod
    def _key(log_a: np.ndarray) -> np.ndarray:
        return ((np.clip(log_a.astype(np.float64), -500, 500) + 512) * 2.0**22).astype(U64) << U64(32)

    def bands(self, row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """Band keys, one row per text that has shingles; texts in order of first appearance."""
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        special = np.flatnonzero(weight != self.other)
        log_weight = np.log(weight[special]).astype(np.float64 if self.drawn is None else np.float32)
        low = hashes & U64(0xFFFFFFFF)
        keys = np.zeros((len(starts), BANDS), U64)
        for h in range(BANDS * BAND_ROWS):
            entry = (hashes * self.odd[h]) >> U64(64 - self.bits)
            value = self.usual[h][entry].astype(U64) << U64(32)
            if len(special):
                value[special] = self._key(self.log_a(h, entry[special], log_weight))
            sample = np.minimum.reduceat(value | low, starts)
            band = h // BAND_ROWS
            keys[:, band] = mix(keys[:, band] * U64(0x9FB21C651E98DF25) + sample)
        return mix(keys + np.arange(1, BANDS + 1, dtype=U64) * U64(0xD1B54A32D192ED03))


_SAMPLERS: dict[tuple[float, bool], Sampler] = {}


def _sampler(weigh: Weights) -> Sampler:
    """The tables, made once per Python worker."""
    key = weigh.other, weigh.total is not None
    if key not in _SAMPLERS:
        _SAMPLERS[key] = Sampler(*key)
    return _SAMPLERS[key]


def _signed(
    weigh: Weights, content: tuple[np.ndarray, np.ndarray], row: np.ndarray, hashes: np.ndarray, counts: np.ndarray, frequencies: np.ndarray | None = None,
) -> list[pa.Array]:
    """content, second, total and bands of some texts."""
    texts = len(content[0])
    weight = weigh.of(hashes, counts, frequencies)
    total = np.bincount(row, weight, minlength=texts).astype(np.float64)
    bands: list[list[int]] = [[] for _ in range(texts)]
    if len(row):
        for text_row, keys in zip(np.unique(row), _sampler(weigh).bands(row, hashes, weight, texts).view(np.int64), strict=True):
            bands[text_row] = keys
    return [*map(pa.array, content), pa.array(total), pa.array(bands, pa.list_(pa.int64()))]


def signatures(docs: DataFrame, weights: Weights, doc_id: str, text: str) -> DataFrame:
    """(id, written, content, second, total, bands) of each document: hashes of its text and its words, weight of its set, band keys."""
    known = docs.sparkSession.sparkContext.broadcast(weights)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column("text")):
                found, *sets = shingles(whole.column("text").slice(lo, hi - lo))
                signs = _signed(known.value, _content(found), *sets)
                yield pa.RecordBatch.from_arrays([
                    whole.column("id").slice(lo, hi - lo), whole.column("written").slice(lo, hi - lo), *signs,
                ], names=["id", "written", "content", "second", "total", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("written"), F.col(text).alias("text")).mapInArrow(
        signed, "id long, written long, content long, second long, total double, bands array<long>")


def _own(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = pc.value_counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["text", "n"])


def _summed(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the sum of `n` for each, and the place of each hash among them."""
    unique, place = np.unique(hashes, return_inverse=True)
    sums = np.zeros(len(unique), np.int64)
    np.add.at(sums, place, n)
    return unique, sums, place


def _packed(ascending: np.ndarray) -> bytes:
    """Ascending hashes as the steps between them, byte by byte, so that the high bytes, mostly zero, compress."""
    return np.diff(ascending, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view(U64).ravel(), dtype=U64)


def _narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; how many there are has to be known to read them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


class _Home:
    """Texts of one home in order of their keys, with their shingles and, if `named`, the hashes of their words."""

    def __init__(self, table: pa.Table, named: bool = False) -> None:
        table = table.take(pc.sort_indices(table, [("own", "ascending")]))
        self.own, copies, texts = table["own"].combine_chunks(), table["n"].to_numpy(), table["text"].combine_chunks()
        self.ranges, self.sets, self.content, documents = list(pieces(texts, _PIECE)), [], [], []
        for lo, hi in self.ranges:
            found, *sets = shingles(texts.slice(lo, hi - lo))
            self.sets.append(sets)
            self.content.append(_content(found) if named else None)
            documents.append(copies[lo + sets[0]])
        self.hashes, self.documents, self.place = _summed(np.concatenate([x[1] for x in self.sets]), np.concatenate(documents))


def text_signatures(docs: DataFrame, weights: Weights, text: str) -> DataFrame:
    """(own, content, second, total, bands, frequencies) of each distinct text that is not NULL, `own` being its SHA-256.

    `frequencies` holds the document frequencies of the text's shingles, in the order `shingles` gives them. A home ships each of its
    distinct shingles once, with the number of its documents; the bucket that the shingle belongs to adds these up.
    """
    size = text_total(docs, text)[1]
    homes, buckets = parts_for(size, HOME_BYTES), parts_for(size / 6, BUCKET_SHINGLES)
    known = docs.sparkSession.sparkContext.broadcast(weights)
    dealt = (
        docs.select(F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(_collapse, "text string, n long")
        .withColumn("own", _own("text")).withColumn("home", F.pmod(F.xxhash64("own"), F.lit(homes)))
        .repartition("home").groupBy("home", "own", "text").agg(F.sum("n").alias("n"))
    )

    def ship(key: tuple, table: pa.Table) -> pa.Table:
        home = _Home(table)
        bucket = ((home.hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        ends = [*first[1:], len(bucket)][:len(first)]
        return pa.table({
            "bucket": pa.array(bucket[first]), "home": pa.array([key[0].as_py()] * len(first), pa.int64()),
            "n": pa.array([b - a for a, b in zip(first, ends, strict=True)], pa.int64()),
            "hashes": pa.array([_packed(home.hashes[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()),
            "documents": pa.array([_narrow(home.documents[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()),
        })

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table["hashes"].to_pylist()]
        documents = np.concatenate([_wide(x, len(p)) for x, p in zip(table["documents"].to_pylist(), parts, strict=True)])
        _, sums, place = _summed(np.concatenate(parts), documents)
        answers, ends = sums[place], np.cumsum([len(p) for p in parts])
        return pa.table({
            "home": table["home"].cast(pa.int64()), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int64()), "n": table["n"].cast(pa.int64()),
            "answers": pa.array([_narrow(answers[b - len(p):b]) for p, b in zip(parts, ends, strict=True)], pa.binary()),
        })

    def sign(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        weigh, home = known.value, _Home(table, named=True)
        # Buckets ascend with the hashes.
        answers = answers.sort_by("bucket")
        back = [_wide(x, n) for x, n in zip(answers["answers"].to_pylist(), answers["n"].to_pylist(), strict=True)]
        frequencies = np.concatenate([np.zeros(0, np.int64), *back])[home.place]
        signs, each, done = [[] for _ in range(4)], [], 0
        for (lo, hi), content, (row, hashes, counts) in zip(home.ranges, home.content, home.sets, strict=True):
            mine = frequencies[done:done + len(hashes)]
            done += len(hashes)
            for column, sign_ in zip(signs, _signed(weigh, content, row, hashes, counts, mine), strict=True):
                column.append(sign_)
            bounds = np.searchsorted(row, np.arange(hi - lo + 1))
            each += [mine[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = dict(zip(("content", "second", "total", "bands"), (pa.chunked_array(c) for c in signs), strict=True))
        return pa.table({"own": home.own.cast(pa.binary()), **columns, "frequencies": pa.array(each, pa.binary())})

    by_home = dealt.groupBy("home")
    added = by_home.applyInArrow(ship, "bucket long, home long, n long, hashes binary, documents binary").groupBy("bucket").applyInArrow(
        add_up, "home long, bucket long, n long, answers binary")
    return by_home.cogroup(added.groupBy("home")).applyInArrow(
        sign, "own binary, content long, second long, total double, bands array<long>, frequencies binary")


def _frequencies(rows: pa.RecordBatch | pa.Table, name: str = "frequencies") -> np.ndarray | None:
    """The document frequencies that some texts came with, one after the other."""
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), np.int64) if name in rows.schema.names else None


def _similarity(weigh: Weights, pairs: pa.RecordBatch) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = pairs.num_rows
    _, row_a, hash_a, count_a = shingles(pairs.column("left_text"))
    _, row_b, hash_b, count_b = shingles(pairs.column("right_text"))
    weight_a = weigh.of(hash_a, count_a, _frequencies(pairs, "left_frequencies"))
    weight_b = weigh.of(hash_b, count_b, _frequencies(pairs, "right_frequencies"))
    row, hashes, weight = np.concatenate((row_a, row_b)), np.concatenate((hash_a, hash_b)), np.concatenate((weight_a, weight_b))
    order = np.lexsort((hashes, row))
    row, hashes, weight = row[order], hashes[order], weight[order]
    twice = np.flatnonzero((row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1]))
    shared = np.bincount(row[twice], np.minimum(weight[twice], weight[twice + 1]), minlength=n)
    both = np.bincount(row, weight, minlength=n) - shared
    return shared / np.maximum(both, 1e-300)


def _all_signatures(scratch: Scratch, docs: DataFrame, weights: Weights, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """What `signatures` gives, under the weight of each shingle's own document frequency; and each text's frequencies."""
    texts = scratch.cut(text_signatures(docs, weights, text), "text-signatures")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("written"), _own(text).alias("of"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    signed = rows.join(texts.drop("frequencies"), F.col("of") == F.col("own"), "left").select(
        "id", "written", F.coalesce("content", zero).alias("content"), F.coalesce("second", zero).alias("second"),
        F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("bands", none).alias("bands"))
    return signed, texts.select("own", "frequencies")


def _classes(docs: DataFrame, doc_id: str, text: str, similar: float, common: int | None) -> tuple[DataFrame, DataFrame]:
    """The signatures, and of each set of equal words the class: rep, class_id, class_size, and the document that stands for the class."""
    frequencies = None
    with Scratch(docs.sparkSession, "near") as scratch:
        if common is None:
            total = docs.count()
            weights = Weights(np.zeros(0, U64), np.zeros(0), float(np.sqrt(np.log1p(min(total, RARE)))), total)
            signed, frequencies = _all_signatures(scratch, docs, weights, doc_id, text)
        else:
            weights = document_frequencies(docs, text, common)
            signed = signatures(docs, weights, doc_id, text)
        signed = cut(signed, "near-signatures")
        return signed, _classes_of(scratch, docs, signed, weights, frequencies, doc_id, text, similar)


def _classes_of(
    scratch: Scratch, docs: DataFrame, signed: DataFrame, weights: Weights, frequencies: DataFrame | None, doc_id: str, text: str, similar: float,
) -> DataFrame:
    wordy = signed.where(F.size("bands") > 0)
    # One document stands for all with the same words.
    groups = wordy.groupBy("content", "second").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "written")).alias("x"), F.count(F.lit(1)).alias("n"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    groups = scratch.cut(groups.select("*", "x.id", "x.written", F.xxhash64("content", "second").alias("rep")).drop("x"), "groups")
    banded = groups.select("rep", "total", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = scratch.cut(banded.join(shared, "key"), "buckets")
    links = _links(scratch, docs, groups, buckets, weights, frequencies, doc_id, text, similar)
    labels = components(links)
    classes = groups.select("rep", "id", "n", "content", "second").join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep"))
    return _named(classes)


def _named(classes: DataFrame) -> DataFrame:
    """rep, class_id, class_size and keeper of each set of equal words, from rep, label, id, n, content, second."""
    per_class = classes.groupBy("label").agg(
        F.min("id").alias("class_id"), F.sum("n").alias("class_size"),
        F.min(F.struct(F.col("id").isNull(), "id", "content", "second")).alias("keeper"),
    )
    return cut(classes.select("rep", "label").join(per_class, "label").drop("label"), "near-classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, common: int | None = COMMON) -> DataFrame:
    """The class of each document: doc_id, class_id (the smallest doc_id of the class), class_size.

    With `common` None each shingle weighs by its own document frequency, as far as 1 in `RARE` documents; else those in fewer than 1 of `common` documents weigh alike. Two documents are linked from a weighted Jaccard similarity of `similar` on; a class is what links connect.
    Texts of the same words are always one class. NULL texts and texts without words are classes
    of their own, one per row; class_id is then the row's own doc_id. A NULL doc_id is a document
    too; a class of such alone has the class_id NULL. Rows that agree in everything are
    several documents of one class. An empty table has no classes.
    """
    signed, classes = _classes(docs, doc_id, text, similar, common)
    named = classes.select(F.col("rep").alias("r"), "class_id", "class_size")
    with_class = signed.where(F.size("bands") > 0).select("id", F.xxhash64("content", "second").alias("rep")).join(named, F.col("rep") == F.col("r"))
    alone = signed.where(F.size("bands") == 0).select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return with_class.select(F.col("id").alias("doc_id"), "class_id", "class_size").union(alone)


def _links(
    scratch: Scratch, docs: DataFrame, groups: DataFrame, buckets: DataFrame, weights: Weights, frequencies: DataFrame | None, doc_id: str, text: str, similar: float,
) -> DataFrame:
    """Verified links (a, b) between documents that share a bucket, enough to connect each class."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(weights)
    wanted = groups.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("id").alias("of"), "written")

    def with_rep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column("text")):
                batch = whole.slice(lo, hi - lo)
                content, second = _content(words(batch.column("text"), _WORDS))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("text"), pa.array(content), pa.array(second)], names=["rep", "text", "content", "second"])

    # An id, or none, may stand for many texts: the hash of the text is part of the key, so that they do not all meet. That of the
    # words decides.
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("own"), F.col(text).alias("text"))
    found = rows.join(wanted, (F.col("own") == F.col("written")) & F.col("id").eqNullSafe(F.col("of"))).select("rep", "text") \
        .mapInArrow(with_rep, "rep long, text string, content long, second long").where(F.xxhash64("content", "second") == F.col("rep"))
    found = found.select("rep", "text")
    if frequencies is not None:
        found = found.join(frequencies, _own("text") == F.col("own")).drop("own")
    texts = scratch.cut(found, "texts")
    values = texts.drop("rep").columns
    # Rows may repeat an id and its text.
    if not texts.groupBy("rep").count().where("count > 1").isEmpty():
        texts = scratch.cut(texts.groupBy("rep").agg(F.min(F.struct(*values)).alias("x")).select("rep", "x.*"), "texts")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column("left_text"), _PIECE):
                batch = whole.slice(lo, hi - lo)
                good = _similarity(known.value, batch) >= similar - 1e-9
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    # The smallest of a bucket leads, found by an aggregate that combines before its shuffle.
    first = buckets.groupBy("key").agg(F.min(F.struct("rep", "total")).alias("x")).select("key", F.col("x.rep").alias("a"), F.col("x.total").alias("a_total"))
    pairs = buckets.join(first, "key").where(F.col("rep") > F.col("a"))
    # No set can be similar to one of much more weight.
    pairs = pairs.where(F.least("total", "a_total") >= F.greatest("total", "a_total") * (similar - 1e-9))
    pairs = scratch.cut(pairs.select("a", F.col("rep").alias("b")).distinct(), "pairs")
    left = pairs.join(texts.select(F.col("rep").alias("a"), *[F.col(c).alias(f"left_{c}") for c in values]), "a")
    both = left.join(texts.select(F.col("rep").alias("b"), *[F.col(c).alias(f"right_{c}") for c in values]), "b")
    links = scratch.cut(both.mapInArrow(verified, "a long, b long"), "links")

    labels = components(links)
    labelled = buckets.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("label"), "total")
    # Buckets of the same documents are compared once, and two documents only if no leader was compared with both.
    state = labelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("rep")).alias("same"), F.sum(F.shiftright(F.xxhash64("rep", F.lit(1)), 24)).alias("same_too"),
    ).where("low != high AND n > 2")
    still = scratch.cut(state.groupBy("n", "same", "same_too").agg(F.min("key").alias("key")).select("key"), "open")
    if still.isEmpty():
        return links
    # Rows of a block are of like total weight, as no set can be similar to one of much more: only neighbouring sizes meet.
    # Classes that fill blocks get blocks of their own: two blocks of one class have nothing to compare. The other rows share blocks.
    step = -np.log(max(similar - 1e-9, 1e-9)) * (1 + 1e-9)
    opened = labelled.join(still, "key").withColumn("size", F.floor(F.log("total") / step))
    filling = opened.groupBy("key", "size", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("alone", F.when(F.col("n") >= BLOCK, F.col("label")))
    others = F.sum(F.when(F.col("alone").isNull(), F.col("n"))).over(Window.partitionBy("key", "size"))
    filling = filling.select("key", "size", "label", "alone", F.ceil(F.when(F.col("alone").isNull(), others).otherwise(F.col("n")) / BLOCK).alias("blocks"))
    opened = opened.join(scratch.cut(filling, "filling"), ["key", "size", "label"]).withColumn("block", F.pmod(F.xxhash64("rep", "key"), "blocks")).join(texts, "rep")

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        _, row, hashes, counts = shingles(table["text"].combine_chunks())
        # A shingle that stands three times is three columns, so shared weight is a sum of products.
        # Weights are few, so columns have the number of theirs.
        kinds, kind = np.unique(known.value.of(hashes, np.ones(len(hashes)), _frequencies(table)), return_inverse=True)
        kind = kind.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32)
        nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        column = mix(np.repeat(hashes, counts) + nth.astype(U64) * U64(0x9E3779B97F4A7C15))
        return pa.table({
            **{name: pa.array([part.as_py()], pa.int64()) for name, part in zip(place, key, strict=True)},
            "reps": pa.array([table["rep"].to_numpy().tobytes()], pa.binary()), "labels": pa.array([table["label"].to_numpy().tobytes()], pa.binary()),
            "sizes": pa.array([np.bincount(row, counts, minlength=table.num_rows).astype(np.int64).tobytes()], pa.binary()), "columns": pa.array([column.tobytes()], pa.binary()),
            "kinds": pa.array([kinds.tobytes()], pa.binary()), "kind": pa.array([np.repeat(kind, counts).tobytes()], pa.binary()),
        })

    place = ("key", "size", "alone", "block")
    shape = ", ".join(f"{c} long" for c in place) + ", reps binary, labels binary, sizes binary, columns binary, kinds binary, kind binary"
    blocks = opened.select(*place, "rep", "label", *values).groupBy(*place).applyInArrow(packed, shape)
    blocks = scratch.cut(blocks.withColumns({"name": F.concat_ws("|", *place), "bytes": F.octet_length("columns") + F.octet_length("kind")}).drop("block"), "blocks")
    # Every two blocks of a bucket once, a shared block with itself too, and none of the same class throughout; names only.
    names = blocks.select("key", "size", "alone", "name", "bytes")
    others = names.select(*[F.col(c).alias(f"r_{c}") for c in names.columns])
    near_by = (F.col("r_size") == F.col("size") + 1) | ((F.col("r_size") == F.col("size")) & (F.col("name") <= F.col("r_name")))
    one_class = F.coalesce(F.col("alone") == F.col("r_alone"), F.lit(False))
    paired = names.join(others, (F.col("key") == F.col("r_key")) & near_by & ~one_class)
    tiles = scratch.cut(paired.select("name", "r_name", (F.col("bytes") + F.col("r_bytes")).alias("bytes")), "tiles")
    # The first of two blocks is shipped once for each tile, the second once for each task that needs it.
    parts = parts_for(tiles.agg(F.sum("bytes")).first()[0] or 0, TASK_BYTES)
    slices = tiles.groupBy("r_name").agg(F.ceil(F.sum("bytes") / TASK_BYTES).alias("slices"))
    packs = blocks.drop("key", "size", "alone", "bytes")
    firsts = tiles.drop("bytes").join(slices, "r_name").withColumn("slice", F.pmod(F.xxhash64("name"), "slices")).drop("slices").join(packs, "name").drop("name")
    seconds = packs.select(*[F.col(c).alias(f"r_{c}") for c in packs.columns]).join(slices, "r_name")
    seconds = seconds.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    met = ["r_name", "slice"]
    tiles = firsts.repartition(parts, *met).join(seconds.repartition(parts, *met), met).drop(*met)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = _tile_links(batch.slice(row, 1).to_pylist()[0], similar)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    more = tiles.mapInArrow(compared, "a long, b long")
    return links.union(scratch.cut(more, "links"))


def _tile_links(tile: dict, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between documents of two blocks that are not yet of one class, enough to connect them."""
    def side(prefix: str) -> tuple[np.ndarray, ...]:
        reps, labels, sizes, columns, kinds = (
            np.frombuffer(tile[f"{prefix}{c}"], t)
            for c, t in (("reps", np.int64), ("labels", np.int64), ("sizes", np.int64), ("columns", U64), ("kinds", np.float64)))
        kind = np.frombuffer(tile[f"{prefix}kind"], np.uint16 if len(kinds) <= 1 << 16 else np.uint32)
        return reps, labels, np.repeat(np.arange(len(reps)), sizes), columns, kinds[kind]

    reps_a, labels_a, rows_a, columns_a, weights_a = side("")
    reps_b, labels_b, rows_b, columns_b, weights_b = side("r_")
    total_a, total_b = np.bincount(rows_a, weights_a, minlength=len(reps_a)), np.bincount(rows_b, weights_b, minlength=len(reps_b))
    common = np.intersect1d(columns_a, columns_b)
    shared = np.zeros((len(reps_a), len(reps_b)))
    place_a, place_b = np.searchsorted(common, columns_a), np.searchsorted(common, columns_b)
    for lo in range(0, len(common), COLUMNS):
        part = common[lo:lo + COLUMNS]
        matrices = []
        for rows, columns, place, values, n in ((rows_a, columns_a, place_a, weights_a, len(reps_a)), (rows_b, columns_b, place_b, np.ones(len(rows_b)), len(reps_b))):
            here = np.flatnonzero((place >= lo) & (place < lo + len(part)))
            here = here[common[place[here]] == columns[here]]
            dense = np.zeros((n, len(part)))
            dense[rows[here], place[here] - lo] = values[here]
            matrices.append(dense)
        shared += matrices[0] @ matrices[1].T
    good = shared >= (similar - 1e-9) * (total_a[:, None] + total_b[None, :] - shared)
    good &= labels_a[:, None] != labels_b[None, :]
    at_a, at_b = np.nonzero(good)
    # One link for each two classes is enough to join them.
    names = np.sort(np.stack((labels_a[at_a], labels_b[at_b]), axis=1), axis=1)
    _, first = np.unique(names, axis=0, return_index=True) if len(names) else (None, np.zeros(0, np.int64))
    return reps_a[at_a[first]], reps_b[at_b[first]]


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, common: int | None = COMMON) -> DataFrame:
    """One document of each class of `near_duplicates`, that with the smallest id (NULL last), with the columns it came with.

    Where ids repeat or are NULL, the words of the texts tell rows apart, and one of equal rows stays. Rows without words all stay.
    """
    signed, classes = _classes(docs, doc_id, text, similar, common)
    keepers = classes.select("keeper.id", "keeper.content", "keeper.second").distinct()
    wordless = signed.where(F.size("bands") == 0).select("id", "content", "second")
    several = cut(signed.groupBy("id").count().where("count > 1 OR id IS NULL").select(F.col("id").alias("many")), "near-many")
    key = fresh("kept_id", docs.columns)
    kept = keepers.union(wordless).select(F.col("id").alias(key))
    plain = kept.join(several, F.col(key) == F.col("many"), "left_anti").where(F.col(key).isNotNull())
    single = docs.join(plain, docs[doc_id].cast("long") == F.col(key)).select(*docs.columns)
    if several.isEmpty():
        return single

    new = [fresh(c, docs.columns) for c in ("content", "second")]

    def with_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column(text)):
                batch = whole.slice(lo, hi - lo)
                found = _content(words(batch.column(text), _WORDS))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in found]], names=[*batch.schema.names, *new])

    zero = F.lit(0).cast("long")
    rows = docs.join(several, docs[doc_id].cast("long").eqNullSafe(F.col("many")), "left_semi")
    rows = rows.mapInArrow(with_content, docs.select("*", zero.alias(new[0]), zero.alias(new[1])).schema)
    empty = (F.col(new[0]) == 0) & (F.col(new[1]) == 0)
    named = keepers.select(F.col("id").alias(key), F.col("content").alias(f"{key}_c"), F.col("second").alias(f"{key}_s"))
    same = rows[doc_id].cast("long").eqNullSafe(F.col(key)) & (F.col(new[0]) == F.col(f"{key}_c")) & (F.col(new[1]) == F.col(f"{key}_s"))
    told = rows.where(~empty).join(named, same, "left_semi").dropDuplicates([doc_id, *new])
    return single.union(told.select(*docs.columns)).union(rows.where(empty).select(*docs.columns))
