"""Phrase collocations by dynamic itemset counting.

The texts are dealt to shards, which are scanned one after the other, in circles. A scan counts phrases of several
lengths at once: words from the first scan on, and a longer phrase from the scan after the one in which the running
counts of both its subphrases (all but its last, all but its first word) reached the threshold. A phrase is counted
for one full circle, from wherever it began, so its count is exact; scans end when no phrase is still being counted.

What has reached the threshold is told to the tasks as one byte a slot, of as many slots as `SLOTS` says: the scan in
which a phrase of that slot got there. Phrases that share a slot with another may be counted without need, which
costs time and changes nothing: whatever is counted is counted in all shards, and only counts of the threshold or
more are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from benchloom.llm.arrays import U64, WINDOW_STEP, Alphabet, mix, pieces, words
from benchloom.storage import Scratch, cut

SHARDS = 3
# Bytes that each length but the longest takes in the broadcast, whatever the data are.
SLOTS = 1 << 24
NEVER = 255
UNKNOWN = "und"

_BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_WORD = Alphabet(~_BREAK & ~np.isin(np.arange(256), [0x20, 0x09]), _LOWER)
_ANY = Alphabet(np.ones(256, dtype=bool), np.arange(256, dtype=np.uint8))

_COUNTS = "key string, size int, start int, n long"


def _then(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix(phrase * WINDOW_STEP + word)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % U64(slots)).astype(np.int64)


def _joined_by(separator: str, left: pa.Array, right: pa.Array | str) -> pa.Array:
    long = pa.large_string()
    right = pa.scalar(right, long) if isinstance(right, str) else right
    return pc.binary_join_element_wise(left, right, pa.scalar(separator, long))


def _in_language(langs: pa.Array) -> np.ndarray:
    """Hash of each language name; the tab keeps an empty one from having no hash."""
    return words(_joined_by("", langs, "\t"), _ANY).hashes


class _Texts:
    """Words of some texts, numbered by language and word, and which of them follow each other in one piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        found = words(batch.column("text"), _WORD, hashed=False)
        langs = batch.column("lang").cast(pa.large_string()).dictionary_encode()
        text = found.text_of()
        broken = np.concatenate(([0], np.cumsum(_BREAK[found.flat], dtype=np.int32)))
        self.linked = (broken[found.starts[1:]] == broken[found.starts[:-1]]) & (text[1:] == text[:-1])
        ends = np.concatenate(([0], np.cumsum(found.ends - found.starts))).astype(np.int64)
        letters = found.flat[_WORD.in_word[found.flat]]
        spelt = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)[text]
        many = max(len(spelt.dictionary), 1)
        numbered = pa.array(lang * many + spelt.indices.to_numpy()).dictionary_encode()
        pairs = numbered.dictionary.to_numpy()
        self.ids = numbered.indices.to_numpy().astype(np.int64)
        self.words = spelt.dictionary.take(pa.array(pairs % many))
        self.langs = langs.dictionary.take(pa.array(pairs // many))
        self.hashes = mix(words(spelt.dictionary, _WORD).hashes[pairs % many] ^ _in_language(langs.dictionary)[pairs // many])
        self.keys = _joined_by("\t", self.langs, self.words)

    def named(self, at: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array]:
        """Number of the phrase of `size` words at each place, and the keys that the numbers stand for."""
        name, keys, many = self.ids[at], self.keys, len(self.words)
        for k in range(1, size):
            pair = pa.array(name * many + self.ids[at + k]).dictionary_encode()
            known = pair.dictionary.to_numpy()
            keys = _joined_by(" ", keys.take(pa.array(known // many)), self.words.take(pa.array(known % many)))
            name = pair.indices.to_numpy().astype(np.int64)
        return name, keys


def _rows(keys: pa.Array, size: int, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        keys.cast(pa.string()), pa.array(np.full(len(keys), size), pa.int32()), pa.array(start, pa.int32()), pa.array(n, pa.int64()),
    ], names=["key", "size", "start", "n"])


def _counted(texts: _Texts, step: int, shards: int, reached: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that are being counted in this scan. Size 0 holds all words of a language."""
    ids, hashes = texts.ids, texts.hashes[texts.ids]
    if step < shards:
        n = np.bincount(ids, minlength=len(texts.words))
        yield _rows(texts.keys, 1, np.zeros(len(n)), n)
        of_lang = texts.langs.dictionary_encode()
        total = np.bincount(of_lang.indices.to_numpy(), weights=n, minlength=len(of_lang.dictionary)).astype(np.int64)
        yield _rows(_joined_by("\t", of_lang.dictionary, ""), 0, np.zeros(len(total)), total)
    whole = np.ones(len(ids), dtype=bool)
    for size, slots in enumerate(reached, start=2):
        # `hashes` and `whole` are those of the phrases one word shorter.
        got = np.where(whole, slots[_slot(hashes, len(slots))], NEVER).astype(np.int32)
        start = np.maximum(got[:-1], got[1:]) + 1
        at = np.flatnonzero((start <= step) & (step < start + shards) & texts.linked[:len(start)] & texts.linked[size - 2:])
        if len(at):
            name, keys = texts.named(at, size)
            begun = np.zeros(len(keys), dtype=np.int32)
            begun[name] = start[at]
            yield _rows(keys, size, begun, np.bincount(name, minlength=len(keys)))
        whole = whole[:-1] & texts.linked[size - 2:]
        hashes = _then(hashes[:-1], texts.hashes[ids[size - 1:]])
        if not len(hashes):
            return


def _slots_of(rows: DataFrame, slots: int) -> DataFrame:
    """Size and slot of each phrase in `rows` (size, lang, phrase), once each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = words(batch.column("phrase"), _WORD)
            lang = _in_language(batch.column("lang").cast(pa.large_string()))
            each = mix(parts.hashes ^ lang[parts.text_of()])
            sizes, whole = parts.counts(), np.zeros(len(lang), dtype=U64)
            for k in range(int(sizes.max(initial=0))):
                has = np.flatnonzero(sizes > k)
                word = each[parts.first[has] + k]
                whole[has] = _then(whole[has], word) if k else word
            yield pa.RecordBatch.from_arrays([batch.column("size"), pa.array(_slot(whole, slots), pa.int32())], names=["size", "slot"])

    return rows.select("size", "lang", "phrase").mapInArrow(found, "size int, slot int").distinct()


def _named() -> list[Column]:
    """Language and phrase of a key; a language may hold a tab, a phrase none."""
    phrase = F.substring_index("key", "\t", -1)
    return [F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase")]


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Exact counts (lang, phrase, size, n) of all phrases of at most `longest` words that occur `least` times or more.

    `docs` has columns `lang` and `text`; others play no part. Size 0 with an empty phrase counts all words of a
    language with `least` words or more. A NULL language is `und`; a NULL text is empty. Rows that repeat count as often
    as they stand there; an empty table gives no rows.
    """
    if not 1 <= longest * shards < NEVER:
        raise ValueError("lengths times shards must stay below 255")
    spark = docs.sparkSession
    with Scratch(spark, "phrases") as scratch:
        dealt = docs.select(
            F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
            (F.monotonically_increasing_id() % shards).cast("int").alias("shard"),
        )
        # One folder a shard, so that a scan reads its own texts alone.
        path = f"{scratch.path}/shards"
        dealt.write.partitionBy("shard").parquet(path)
        texts = spark.read.schema(dealt.schema).parquet(path)
        reached = [np.full(slots, NEVER, dtype=np.uint8) for _ in range(longest - 1)]
        running, finished, step, last = None, [], 0, shards - 1
        before = Scratch(spark, "running")
        while step <= last:
            known = spark.sparkContext.broadcast(reached)

            def counted(batches: Iterator[pa.RecordBatch], step=step, known=known) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for lo, hi in pieces(batch.column("text")):
                        yield from _counted(_Texts(batch.slice(lo, hi - lo)), step, shards, known.value)

            # The old counts are read here for the last time.
            with before:
                found = texts.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(counted, _COUNTS).withColumn("old", F.lit(0).cast("long"))
                if running is not None:
                    found = found.unionByName(running.withColumn("old", F.col("n")))
                after = Scratch(spark, "running")
                table = after.cut(found.groupBy("key", "size", "start").agg(F.sum("n").alias("n"), F.sum("old").alias("old")), "counts")
            before = after
            known.destroy()
            ends = F.col("start") + (shards - 1)
            if step >= shards - 1:
                finished.append(scratch.cut(table.where((ends == step) & (F.col("n") >= least)).select("key", "size", "n"), "finished"))
            running = table.where(ends > step).select("key", "size", "start", "n")
            news = table.where((F.col("n") >= least) & (F.col("old") < least) & F.col("size").between(1, longest - 1))
            # At most as many rows as there are slots.
            got = _slots_of(news.select("size", *_named()), slots).toArrow()
            for size, slot in enumerate(reached, start=1):
                new = got["slot"].to_numpy()[got["size"].to_numpy() == size]
                new = new[slot[new] == NEVER]
                slot[new] = step
                if len(new):
                    last = max(last, step + shards)
            step += 1
        before.close()
        out = finished[0]
        for more in finished[1:]:
            out = out.unionByName(more)
        return cut(out.select(*_named(), "size", "n"), "phrase-counts")


def _joined(first: Column, many: Column) -> Column:
    """Key of the `many` words from word `first` of the phrase, counted from 1."""
    return F.concat_ws("\t", "lang", F.array_join(F.slice("words", first, many), " "))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The `top` phrases of each language by how much more often they stand together than apart.

    A phrase of 2 to `longest` words that occurs a >= `least` times is cut in two wherever it can be; a cut scores
    floor(1000000 * a * a / (l * r)), with the counts l and r of its parts, and the lowest counts (of equal ones that
    with fewer words before it). A phrase is dropped if a longer one of these holds it and occurs at least `share`
    percent as often, dropped itself or not. Columns: lang, rank, phrase, a, l, r, n (words of the language), score;
    in order of score, a, phrase. Products are taken in 38 digits. NULLs and repeats as in `phrase_counts`.
    """
    counts = phrase_counts(docs, least, longest, shards, slots)
    by_key = counts.where("size > 0").select(F.concat_ws("\t", "lang", "phrase").alias("part"), F.col("n").alias("part_n"))
    found = counts.where("size > 1").select(
        "lang", "phrase", F.concat_ws("\t", "lang", "phrase").alias("key"), "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"),
    )
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "key", "k", "a", _joined(F.lit(1), F.col("k")).alias("left"), _joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(by_key.select(F.col("part").alias(side), F.col("part_n").alias(name)), side)

    score = F.expr("(1000000 * cast(a AS decimal(38, 0)) * a) div (cast(l AS decimal(38, 0)) * r)")
    lowest = cuts.groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # Every phrase inside a longer one, from 2 words on.
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda many: F.transform(F.sequence(F.lit(1), F.col("size") - many + 1), lambda first: _joined(first, many)),
    ))
    holders = found.where("size > 2").select("a", F.explode(spans).alias("key")).groupBy("key").agg(F.max("a").alias("holder"))
    totals = counts.where("size = 0").select("lang", F.col("n").alias("total"))
    kept = (
        found.join(lowest, "key").join(holders, "key", "left")
        .where(F.col("holder").isNull() | (100 * F.col("holder") < share * F.col("a")))
        .join(totals, "lang")
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
