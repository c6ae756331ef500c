"""Benchmark decontamination: word windows of test items looked up in every window of the documents.

The windows of the test items are hashed and broadcast. A document is scanned once: the hash
of each of its windows is looked up, each hit is verified word by word, and the words it
covers are marked. No document row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from benchloom.llm.arrays import PLAIN, pieces, words
from benchloom.llm.frames import fresh, parts_for
from benchloom.storage import cut

# Test windows in one broadcast, about 200 bytes each in a task. More windows are scanned for in
# blocks of this size, one after the other in the same pass over the documents.
BLOCK_WINDOWS = 500_000


def item_windows(items: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """Distinct windows of n words (item, words, hash, length); an item of fewer words is one window.

    A NULL or wordless text gives none. A NULL item id is kept: its words count as hit, but it
    names no item.
    """
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(batch.column("text"), PLAIN)
            rows: list[tuple] = []
            for row, (lo, hi) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
                length = min(n, hi - lo)
                name = batch.column("item")[row].as_py()
                rows += [(name, found.joined(i, length), length) for i in range(lo, hi - length + 1) if length]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
                pa.array([int(r[2]) for r in rows], pa.int32()),
            ], names=["item", "words", "length"])

    return (
        items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
        .mapInArrow(windows, "item string, words binary, length int").distinct()
    )


class _Block:
    """A block of test windows, ready to look up."""

    def __init__(self, table: pa.Table) -> None:
        self.items: dict[bytes, list[str | None]] = {}
        for item, text in zip(table["item"].to_pylist(), table["words"].to_pylist(), strict=True):
            self.items.setdefault(text, []).append(item)
        by_length: dict[int, list[bytes]] = {}
        for text in self.items:
            by_length.setdefault(text.count(b" ") + 1, []).append(text)
        self.hashes = {}
        for length, texts in by_length.items():
            found = words(pa.array([t.decode() for t in texts], pa.string()), PLAIN)
            self.hashes[length] = np.unique(found.windows(length)[1])

    def hits(self, found) -> Iterator[tuple[int, int, list[str | None]]]:
        """(first word, words, items) of every verified hit."""
        for length, known in self.hashes.items():
            at, hashes = found.windows(length)
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in at[known[place] == hashes]:
                named = self.items.get(found.joined(int(i), length))
                if named is not None:
                    yield int(i), length, named


def _spans(covered: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))


def scan(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = 13, names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"),
) -> DataFrame:
    """`docs` with their words, the hit word ranges and the items hit, in three new columns.

    Words are runs of a-z, 0-9 and everything beyond ASCII, after A-Z became a-z. `hit_spans`
    holds first word and end of each maximal hit run, in turn; `hit_items` the distinct item ids
    as strings, sorted. Documents stay as they are, repeated rows too; a NULL or empty text has
    no words. An empty item table hits nothing. A document column with the name of a new one is an
    error, so pass other `names` then.
    """
    if set(map(str.lower, names)) & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column named as one of {names}")
    spark = docs.sparkSession
    count, spans, hit = names
    table = cut(item_windows(items, item, item_text, n), "test-windows")
    blocks = parts_for(table.count(), BLOCK_WINDOWS)
    out = docs.select(
        "*", F.lit(0).cast("long").alias(count), F.array().cast("array<int>").alias(spans),
        F.array().cast("array<string>").alias(hit),
    )
    for block in range(blocks):
        part = table.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        known = spark.sparkContext.broadcast(_Block(part.toArrow()))

        def scanned(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo, hi in pieces(whole.column(text)):
                    batch = whole.slice(lo, hi - lo)
                    found = words(batch.column(text), PLAIN)
                    covered = np.zeros(len(found.starts), dtype=bool)
                    seen: dict[int, set] = {}
                    old_spans, old_items = batch.column(spans).to_pylist(), batch.column(hit).to_pylist()
                    for row, pairs in enumerate(old_spans):
                        for a, b in zip(pairs[::2], pairs[1::2], strict=True):
                            covered[found.first[row] + a:found.first[row] + b] = True
                    for i, length, named in known.value.hits(found):
                        covered[i:i + length] = True
                        row = int(np.searchsorted(found.first, i, side="right")) - 1
                        seen.setdefault(row, set()).update(x for x in named if x is not None)
                    new_spans = [
                        _spans(covered[a:b]) if covered[a:b].any() else []
                        for a, b in zip(found.first[:-1], found.first[1:], strict=True)
                    ]
                    new_items = [sorted(seen.get(r, set()) | set(old)) for r, old in enumerate(old_items)]
                    columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                    columns[count] = pa.array(found.counts(), pa.int64())
                    columns[spans] = pa.array(new_spans, pa.list_(pa.int32()))
                    columns[hit] = pa.array(new_items, pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        out = out.mapInArrow(scanned, out.schema)
    return out


def n_hit(spans: str = "hit_spans"):
    """Number of hit words, from the ranges."""
    return F.aggregate(
        F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )


def contaminated(share: float = 0.05, count: str = "n_words", spans: str = "hit_spans"):
    """Whether hit words make at least `share` of all words, and any."""
    return (n_hit(spans) > 0) & (n_hit(spans) * round(1 / share) >= F.col(count))


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", share: float = 0.05, **scan_options) -> DataFrame:
    """Documents that are not contaminated, with the columns they came with."""
    names = tuple(fresh(c, docs.columns) for c in ("n_words", "hit_spans", "hit_items"))
    found = scan(docs, items, text, names=names, **scan_options)
    return found.where(~contaminated(share, names[0], names[1])).select(*docs.columns)


def without_spans(found: DataFrame, text: str = "text", spans: str = "hit_spans") -> DataFrame:
    """The output of `scan` with the hit words cut out of the texts.

    A cut goes from the start of a run's first word to the end of its last; what surrounds it stays.
    """
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column(text)):
                batch = whole.slice(lo, hi - lo)
                found_words, texts = words(batch.column(text), PLAIN, hashed=False), batch.column(text).to_pylist()
                begin = np.concatenate(([0], np.cumsum([len((t or "").encode()) for t in texts])))
                for row, pairs in enumerate(batch.column(spans).to_pylist()):
                    if pairs:
                        raw, kept, done = texts[row].encode(), [], 0
                        for a, b in zip(pairs[::2], pairs[1::2], strict=True):
                            kept.append(raw[done:found_words.starts[found_words.first[row] + a] - begin[row]])
                            done = found_words.ends[found_words.first[row] + b - 1] - begin[row]
                        texts[row] = b"".join([*kept, raw[done:]]).decode()
                columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                columns[text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return found.mapInArrow(cut_out, found.schema)
