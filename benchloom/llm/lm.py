"""Language-model scores from a log-frequency Bloom filter.

All n-grams of the training texts are counted; a count becomes a level on a logarithmic scale of two steps an octave
(1, 2, 3, 4, 6, 8, 12, ...), and a filter of bits takes one key for each level up to the n-gram's own. Asking for
level after level until one is missing gives the level back, too high with a small chance and never too low. The probability of a token is that of its unigram (add one), smoothed order by order:
p(w|h) = (c(hw) + mu * p(w|h')) / (c(h) + mu), with counts read from the filter and h' one word shorter than h. An
n-gram is only asked for if the two n-grams inside it are there.

No n-gram is left out, so the filter grows with the texts. `fit_and_score` broadcasts it only if it surely has no more than
`FILTER_BYTES`. Beyond that it lies in buckets of hashes: texts are dealt to homes, a home ships its distinct n-grams with their counts, the bucket
makes its part of the filter and sends back the level of each n-gram that was shipped. `fit` broadcasts all of it, unless it is given a bound:
then the lowest levels are left out for all n-grams alike, and n-grams below it are smoothed from shorter ones. The exact token
counts behind the unigram base score have no cut-off: those of frequent tokens are broadcast, the others joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from benchloom.llm.arrays import SPACED, U64, WINDOW_STEP, Alphabet, mix, pieces, words
from benchloom.llm.frames import fresh, parts_for, text_total
from benchloom.llm.near import _narrow, _packed, _unpacked, _wide
from benchloom.storage import Scratch, cut

ORDER = 2
# Most bytes of a filter that is broadcast.
FILTER_BYTES = 64 << 20
# Bytes of text in a home, and n-grams in a bucket, of a filter that is not.
HOME_BYTES, BUCKET_GRAMS = 2 << 20, 750_000
BLOCK_BITS = 1 << 19
PROBES = 6
# Bits a key takes in a filter that is half full.
KEY_BITS = PROBES / np.log(2)
# Share of the filter that unigrams may take.
UNIGRAM_SHARE = 0.25
# Most tokens whose exact counts are broadcast.
COMMON_TOKENS = 1 << 19
# Weights of the smoothing that are tried.
WEIGHTS = [2.0 ** k for k in range(-2, 13)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_TOKEN = Alphabet(SPACED.in_word, _LOWER)
# No word is empty, so the end of a text is written as the empty token.
END = ""
_BEGIN_HASH, _END_HASH = mix(np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], dtype=U64))
# Bytes of text that are counted at a time; fewer are scored, as the places of a text take far more than its bytes then.
_TEXT_BYTES, _SCORED_BYTES = 2 << 20, 512 << 10


def _scale(levels: int = 124) -> np.ndarray:
    """Smallest count of each level, from level 1 on: 1, 2, 3, 4, 6, 8, 12, ..."""
    return np.array([1] + [(2 + k % 2) << k // 2 for k in range(levels - 1)], dtype=np.int64)


SCALE = _scale()
# Middle of the counts of each level; level 0 is that of what is not there.
MIDDLE = np.concatenate(([0.0], (SCALE[:-1] + SCALE[1:] - 1) / 2))


def level_of(n: str) -> Column:
    """Level of a count."""
    digits = F.bin(F.col(n))
    return F.greatest(F.lit(1), 2 * (F.length(digits) - 1) + (F.substring(digits, 2, 1) == "1").cast("int"))


class _Texts:
    """Tokens of some texts; each text stands between a begin and an end mark."""

    def __init__(self, column: pa.Array) -> None:
        found = words(column, _TOKEN)
        counts = found.counts()
        self.n_texts = len(counts)
        text = np.arange(self.n_texts)
        word = np.arange(len(found.hashes)) + 2 * found.text_of() + 1
        size = len(word) + 2 * self.n_texts
        self.marks = np.empty(size, dtype=U64)
        self.marks[word] = found.hashes
        self.marks[found.first[:-1] + 2 * text] = _BEGIN_HASH
        self.marks[found.first[1:] + 2 * text + 1] = _END_HASH
        self.text = np.repeat(text, counts + 2)
        self.word = word
        self.words_of = counts
        ends = np.concatenate(([0], np.cumsum(found.ends - found.starts))).astype(np.int64)
        letters = found.flat[_TOKEN.in_word[found.flat]]
        spelt = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
        self.token, self.spelling = spelt.indices.to_numpy().astype(np.int64), spelt.dictionary
        self.token_hashes = words(spelt.dictionary, _TOKEN).hashes

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order from 1: the hash of the n-gram that starts at each mark, and whether it lies in one text."""
        hashes, inside = self.marks, np.ones(len(self.marks), dtype=bool)
        yield hashes, inside
        for k in range(2, order + 1):
            hashes = mix(hashes[:-1] * WINDOW_STEP + self.marks[k - 1:])
            inside = self.text[:len(hashes)] == self.text[k - 1:]
            yield hashes, inside


def _rows(token: pa.Array, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([token, pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["token", "h", "n"])


def _counted(texts: _Texts, order: int) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens, by spelling, and of the longer n-grams and the begin mark, by hash."""
    yield _rows(texts.spelling.cast(pa.string()), texts.token_hashes, np.bincount(texts.token, minlength=len(texts.spelling)))
    yield _rows(pa.array([END, None], pa.string()), np.array([_END_HASH, _BEGIN_HASH]), np.full(2, texts.n_texts))
    for hashes, inside in list(texts.grams(order))[1:]:
        found = pa.array(hashes[inside].view(np.int64)).value_counts()
        h = found.field("values").to_numpy()
        yield _rows(pa.nulls(len(h), pa.string()), h, found.field("counts").to_numpy())


@dataclass
class Filter:
    """Bits in blocks: all keys of an n-gram lie in one block. `lowest` are the first levels kept, of unigrams and longer."""

    bits: np.ndarray
    lowest: tuple[int, int]

    def _has(self, hashes: np.ndarray, level: int) -> np.ndarray:
        block = (hashes >> U64(33)) % U64(len(self.bits)) * U64(BLOCK_BITS)
        alive, flat = np.arange(len(hashes)), self.bits.reshape(-1)
        for at in _places(hashes, level):
            place = block[alive] + at[alive]
            alive = alive[(flat[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1]
        return alive

    def levels(self, hashes: np.ndarray, order: int) -> np.ndarray:
        """Level of each n-gram; 0 if it is not there."""
        level = self.lowest[order > 1]
        out, alive = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
        while len(alive) and level < len(MIDDLE) - 1:
            alive = alive[self._has(hashes[alive], level)]
            out[alive] = level
            level += 1
        return out


def _places(hashes: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Bits of a key in its block."""
    first = mix(hashes + U64(level * 0x9E3779B97F4A7C15 % 2**64))
    step = (first >> U64(40)) | U64(1)
    for k in range(PROBES):
        yield (first + U64(k) * step) % U64(BLOCK_BITS)


def _lowest(levels: dict[int, int], most: float) -> int:
    """First level to keep, so that the keys from there on are at most `most`."""
    keys, at_least = 0, 0
    for level in range(max(levels, default=1), 0, -1):
        at_least += levels.get(level, 0)
        keys += at_least
        if keys > most:
            return level + 1
    return 1


def _keys(levels: dict[int, int], lowest: int) -> int:
    return sum(n * (level - lowest + 1) for level, n in levels.items() if level >= lowest)


def _filter(counts: DataFrame, filter_bytes: int | None) -> Filter:
    """The filter of stored `counts` (token, h, n); of all levels if it has no bound."""
    kind = F.when(F.col("token").isNotNull() | (F.col("h") == int(_BEGIN_HASH.view(np.int64))), 0).otherwise(1)
    table: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for row in counts.groupBy(kind.alias("kind"), level_of("n").alias("level")).count().collect():  # a few dozen rows
        table[row["kind"]][row["level"]] = row["count"]
    most, room = (np.inf, np.inf) if filter_bytes is None else (filter_bytes * 8 / KEY_BITS, filter_bytes * 8 // BLOCK_BITS)
    lowest = (_lowest(table[0], UNIGRAM_SHARE * most), 0)
    used = _keys(table[0], lowest[0])
    lowest = (lowest[0], _lowest(table[1], most - used))
    used += _keys(table[1], lowest[1])
    blocks = max(1, int(min(np.ceil(used * KEY_BITS / BLOCK_BITS), room)))

    def block(group: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, dtype=bool)
        hashes = group["h"].to_numpy().view(U64)
        level, first = group["level"].to_numpy(), group["lowest"].to_numpy()
        for k in range(int(first.min()), int(level.max()) + 1):
            for at in _places(hashes[(first <= k) & (level >= k)], k):
                bits[at.astype(np.int64)] = True
        return pa.table({"block": group["block"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    kept = counts.select("h", level_of("n").cast("int").alias("level"), F.when(kind == 0, lowest[0]).otherwise(lowest[1]).alias("lowest"))
    kept = kept.where("level >= lowest").withColumn("block", F.pmod(F.shiftrightunsigned("h", 33), F.lit(blocks)).cast("int"))
    out = np.zeros((blocks, BLOCK_BITS // 8), dtype=np.uint8)
    built = kept.groupBy("block").applyInArrow(block, "block int, bits binary").toArrow()  # the filter itself
    for at, bits in zip(built["block"].to_pylist(), built["bits"], strict=True):
        out[at] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    return Filter(out, lowest)


def _built(hashes: np.ndarray, level: np.ndarray) -> Filter:
    """The filter of these n-grams, of all levels."""
    blocks = max(1, int(np.ceil(level.sum() * KEY_BITS / BLOCK_BITS)))
    bits = np.zeros(blocks * BLOCK_BITS, dtype=bool)
    block = (hashes >> U64(33)) % U64(blocks) * U64(BLOCK_BITS)
    for k in range(1, int(level.max(initial=0)) + 1):
        has = level >= k
        for at in _places(hashes[has], k):
            bits[(block[has] + at).astype(np.int64)] = True
    return Filter(np.packbits(bits, bitorder="little").reshape(blocks, -1), (1, 1))


@dataclass
class _Answers:
    """Levels that came back from the filter for the n-grams of a home, whose hashes ascend."""

    hashes: np.ndarray
    level: np.ndarray

    def levels(self, hashes: np.ndarray, order: int) -> np.ndarray:
        return self.level[np.searchsorted(self.hashes, hashes)]


@dataclass
class Model:
    """Filter, smoothing weights of orders 2 and up, tokens and distinct tokens of the training texts, exact counts."""

    filter: Filter | _Answers
    weights: list[float]
    train_tokens: int
    distinct: int
    train_texts: int
    common: pa.Array  # tokens whose exact counts are at hand, in order of hash
    common_hashes: np.ndarray
    common_counts: np.ndarray
    rare: DataFrame | None  # stored table (token, n) of all others

    def exact(self, texts: _Texts) -> tuple[np.ndarray, np.ndarray]:
        """Exact count of each distinct token, 0 where it is not at hand, and whether it is."""
        if not len(self.common_hashes) or not len(texts.token_hashes):
            return np.zeros(len(texts.spelling), np.int64), np.zeros(len(texts.spelling), bool)
        at = np.minimum(np.searchsorted(self.common_hashes, texts.token_hashes), len(self.common_hashes) - 1)
        known = self.common_hashes[at] == texts.token_hashes
        known &= pc.equal(self.common.take(pa.array(at)), texts.spelling).to_numpy(zero_copy_only=False)
        return np.where(known, self.common_counts[at], 0), known


def _orders(model: Model, texts: _Texts, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1: probabilities of the marks, which the caller smooths in place; counts of the n-grams that end at the marks
    from there on, and of their contexts; whether they lie in one text.
    """
    p, below = np.ones(len(texts.marks)), np.zeros(0, np.int64)
    for k, (hashes, inside) in enumerate(texts.grams(order), start=1):
        ask = inside if k == 1 else inside & (below[:-1] > 0) & (below[1:] > 0)
        found = pa.array(hashes[ask].view(np.int64)).dictionary_encode()
        level = np.zeros(len(hashes), dtype=np.int64)
        level[ask] = model.filter.levels(found.dictionary.to_numpy().view(U64), k)[found.indices.to_numpy()]
        n = context = MIDDLE[level]
        if k == 1:
            p[:] = (n + 1) / (model.train_tokens + model.distinct + 1)
        else:
            context = MIDDLE[below[:-1]]
            n = np.minimum(n, context)
        yield k, p, n, context, inside
        below = level


def _encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the number of each place's value among them."""
    found = pa.array(values).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)


@dataclass
class _Last:
    """Places of some texts at the last order, whose weight may still be open.

    Counts are levels, so that few places differ: equal ones are of one kind. `n`, `context` and `p`, the probability one
    order lower, are those of the kinds; `fixed` is log10 of what no weight of this order changes, by text.
    """

    n: np.ndarray
    context: np.ndarray
    p: np.ndarray
    kind: np.ndarray
    text: np.ndarray
    fixed: np.ndarray

    def fits(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """Log-likelihood of the texts, or those `chosen`, under each of `WEIGHTS`, every place left out of its own counts."""
        kind = self.kind if chosen is None else self.kind[chosen[self.text]]
        times = np.bincount(kind, minlength=len(self.n))
        context = np.maximum(self.context - 1, 0)
        n = np.minimum(np.maximum(self.n - 1, 0), context)
        return np.array([np.sum(times * np.log((n + w * self.p) / (context + w))) for w in WEIGHTS])

    def log10(self, weight: float) -> np.ndarray:
        """log10 of the probability of each text."""
        logs = np.log10((self.n + weight * self.p) / (self.context + weight))
        return self.fixed + np.bincount(self.text, weights=logs[self.kind], minlength=len(self.fixed))


def _last(model: Model, texts: _Texts, order: int) -> _Last:
    """The places of the texts at this order, smoothed with the model's weights below it."""
    for k, p, n, context, inside in _orders(model, texts, order):
        if 1 < k < order:
            smoothed = (n + model.weights[k - 2] * p[k - 1:]) / (context + model.weights[k - 2])
            p[k - 1:] = np.where(inside, smoothed, p[k - 1:])
    here = np.zeros(len(p), dtype=bool)
    if order > 1:
        here[order - 1:] = inside
    token = np.concatenate(([False], texts.text[1:] == texts.text[:-1])) & ~here
    fixed = np.bincount(texts.text[token], weights=np.log10(p[token]), minlength=texts.n_texts)
    if order == 1:
        n = context = np.zeros(0)
        inside = np.zeros(0, dtype=bool)
    parts = [_encoded(x) for x in (n[inside], context[inside], p[here])]
    keys = np.zeros(len(parts[0][1]), np.int64)
    for values, number in parts:
        keys = keys * len(values) + number
    kinds, kind = _encoded(keys)
    columns = []
    for values, _ in reversed(parts):
        columns.append(values[kinds % max(len(values), 1)])
        kinds = kinds // max(len(values), 1)
    p, context, n = columns
    return _Last(n, context, p, kind, texts.text[here], fixed)


def _texts(batches: Iterator[pa.RecordBatch], text: str, size: int = _TEXT_BYTES) -> Iterator[tuple[pa.RecordBatch, _Texts]]:
    for whole in batches:
        for lo, hi in pieces(whole.column(text), size):
            batch = whole.slice(lo, hi - lo)
            yield batch, _Texts(batch.column(text))


def fit(train: DataFrame, text: str = "text", order: int = ORDER, filter_bytes: int | None = None, common_tokens: int = COMMON_TOKENS) -> Model:
    """Model of the texts in `train`: all of them are counted, and the smoothing weights are fitted on all of them.

    The filter holds all that was counted, or no more than `filter_bytes`.

    A weight is that of `WEIGHTS` under which the texts are likeliest when each place is left out of its own counts.
    A NULL text is empty and counts as one; repeated rows count as often as they stand there. Without any text every
    token is unknown.
    """
    return _fit(train, text, order, filter_bytes, common_tokens, order)


def _counts(train: DataFrame, order: int) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, "text"):
            yield from _counted(texts, order)

    return train.mapInArrow(counted, "token string, h long, n long").groupBy("token", "h").agg(F.sum("n").alias("n"))


def _of_tokens(counts: DataFrame, known: Filter, common_tokens: int) -> Model:
    """The model without weights, from the stored counts of tokens."""
    tokens = counts.where("token IS NOT NULL")
    ends = F.coalesce(F.sum(F.when(F.col("token") == END, F.col("n"))), F.lit(0))
    train_tokens, distinct, train_texts = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), ends).first()
    of_level = {r["level"]: r["count"] for r in tokens.groupBy(level_of("n").alias("level")).count().collect()}
    # Frequent tokens are those of the levels that, from the top, are few enough together.
    first, held = max(of_level, default=0) + 1, 0
    while first > 1 and held + of_level.get(first - 1, 0) <= common_tokens:
        first -= 1
        held += of_level.get(first, 0)
    least = int(SCALE[first - 1])
    # The end of a text has its count beside them.
    spelt = tokens.where(F.col("token") != END)
    common = spelt.where(F.col("n") >= least).toArrow()
    hashes = common["h"].to_numpy().view(U64)
    distinct_hashes, at, times = np.unique(hashes, return_index=True, return_counts=True)
    alone = at[times == 1]
    spelling = common["token"].cast(pa.large_string()).combine_chunks()
    # Tokens that share a hash are looked up by spelling, with the rare ones.
    shared = spelling.take(pa.array(np.flatnonzero(np.isin(hashes, distinct_hashes[times > 1])))).to_pylist()
    rare = cut(spelt.where((F.col("n") < least) | F.col("token").isin(shared)).select("token", "n"), "lm-rare-tokens")
    return Model(known, [], train_tokens, distinct, train_texts, spelling.take(pa.array(alone)), hashes[alone], common["n"].to_numpy()[alone], rare)


def _fit(train: DataFrame, text: str, order: int, filter_bytes: int | None, common_tokens: int, weighted: int) -> Model:
    """The model, with weights of the orders up to `weighted`."""
    if order < 1:
        raise ValueError("an n-gram has at least one word")
    spark = train.sparkSession
    train = train.select(F.col(text).alias("text"))
    with Scratch(spark, "lm") as scratch:
        counts = scratch.cut(_counts(train, order), "counts")
        model = _of_tokens(counts, _filter(counts, filter_bytes), common_tokens)
    for k in range(2, weighted + 1):
        sent = _sent(spark, model)

        def tried(batches: Iterator[pa.RecordBatch], k=k, sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(WEIGHTS))
            for _, texts in _texts(batches, "text", _SCORED_BYTES):
                sums += _last(sent.value, texts, k).fits()
            yield pa.RecordBatch.from_arrays([pa.array(WEIGHTS), pa.array(sums)], names=["weight", "fit"])

        model = _weighed(model, train.mapInArrow(tried, "weight double, fit double"))
        sent.destroy()
    return model


def _weighed(model: Model, fits: DataFrame) -> Model:
    """The model with the next weight, that of the best sum of `fits` (weight, fit)."""
    sums = fits.groupBy("weight").agg(F.sum("fit").alias("fit")).collect()
    return replace(model, weights=[*model.weights, max(sums, key=lambda r: (r["fit"], -r["weight"]))["weight"] if sums else 1.0])


def _sent(spark, model: Model) -> Broadcast:
    """The model without its stored table."""
    return spark.sparkContext.broadcast(replace(model, rare=None))


_NAMES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", names: tuple[str, str, str, str, str] = _NAMES) -> DataFrame:
    """The columns `keep` of `docs` with tokens, known tokens, training tokens, base score and score of each text.

    Tokens are the words of the text, A-Z as a-z, and its end; an empty or NULL text is its end alone. The base score
    adds log10((c + 1) / (N + V + 1)) over the tokens, with exact counts c of V distinct among N training tokens; the
    score is the model's log10 probability of the text. Rows stay as they are, repeated ones too. Names of new columns
    must not be among those kept.
    """
    _check(keep, names)
    return _score(docs, model, len(model.weights) + 1, None, keep, text, names)


def fit_and_score(
    docs: DataFrame, train: Column, keep: list[str], text: str = "text", order: int = ORDER, filter_bytes: int = FILTER_BYTES,
    common_tokens: int = COMMON_TOKENS, names: tuple[str, str, str, str, str] = _NAMES,
) -> DataFrame:
    """`score` of all `docs` by the model that `fit` makes of those for which `train` holds.

    The filter is asked about a text once, both for the weight of the last order, fitted on all training texts, and for
    the score: texts are scored under each of `WEIGHTS`, and the weight is picked afterwards. A filter that may have more than
    `filter_bytes` is not broadcast but lies in buckets. Rows that agree in their text and all of `keep` share a home there.
    """
    _check(keep, names)
    n_rows, size = text_total(docs, text)
    # A level costs a key, and no n-gram has more levels than occurrences; a word has a byte and a gap, a text two marks.
    if order * (size / 2 + 3 * n_rows) * KEY_BITS / 8 <= filter_bytes:
        model = _fit(docs.where(train), text, order, None, common_tokens, order - 1)
        return _score(docs, model, order, train, keep, text, names)
    return _score_in_homes(docs, train, keep, text, order, common_tokens, names, parts_for(size, HOME_BYTES), parts_for(order * size / 6, BUCKET_GRAMS))


def _learnt(batch: pa.RecordBatch, trains: str) -> np.ndarray:
    return batch.column(trains).to_numpy(zero_copy_only=False).astype(bool)


def _score_in_homes(
    docs: DataFrame, train: Column, keep: list[str], text: str, order: int, common_tokens: int, names: tuple[str, str, str, str, str], homes: int, buckets: int,
) -> DataFrame:
    """`fit_and_score` with a filter in buckets, which are asked by the homes of the texts."""
    if order < 1:
        raise ValueError("an n-gram has at least one word")
    spark = docs.sparkSession
    read, trains, home = fresh("text", keep), fresh("trains", keep, names), fresh("home", keep, names)
    told = [F.col(f.name) for f in docs.select(*keep).schema if not any(x in f.dataType.simpleString() for x in ("map", "variant"))]
    rows = docs.select(*keep, F.col(text).alias(read), F.coalesce(train, F.lit(False)).alias(trains), F.pmod(F.xxhash64(F.col(text), *told), F.lit(homes)).alias(home))
    by_home = rows.repartition(home).groupBy(home)

    def texts_of(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, _Texts]]:
        return _texts(table.combine_chunks().to_batches(), read, _SCORED_BYTES)

    def ship(key: tuple, table: pa.Table) -> pa.Table:
        found, times = [], []
        for batch, texts in texts_of(table):
            learnt = _learnt(batch, trains)
            for hashes, inside in texts.grams(order):
                found.append(hashes[inside])
                times.append(learnt[texts.text[:len(hashes)][inside]])
        hashes, place = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(place, np.concatenate(times), minlength=len(hashes)).astype(np.int64)
        bucket = ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        bounds = list(zip(first, [*first[1:], len(bucket)], strict=True))
        return pa.table({
            "bucket": pa.array(bucket[first]), "home": pa.array([key[0].as_py()] * len(first), pa.int64()),
            "grams": pa.array([b - a for a, b in bounds], pa.int64()), "hashes": pa.array([_packed(hashes[a:b]) for a, b in bounds], pa.binary()),
            "counts": pa.array([_narrow(n[a:b]) for a, b in bounds], pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table["hashes"].to_pylist()]
        hashes, place = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.concatenate([_wide(x, len(p)) for x, p in zip(table["counts"].to_pylist(), parts, strict=True)])
        n = np.bincount(place, n, minlength=len(hashes)).astype(np.int64)
        level = _built(hashes[n > 0], np.searchsorted(SCALE, n[n > 0], side="right")).levels(hashes, 1).astype(np.uint8)[place]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({
            "of_home": table["home"].cast(pa.int64()), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int64()),
            "levels": pa.array([level[b - len(p):b].tobytes() for p, b in zip(parts, ends, strict=True)], pa.binary()),
        })

    def known(model: Model, table: pa.Table, answers: pa.Table) -> Model:
        """The model with the levels of all n-grams of a home, which lie in the buckets in ascending order."""
        levels = b"".join(answers.sort_by("bucket")["levels"].to_pylist())
        hashes = np.unique(np.concatenate([h[inside] for _, texts in texts_of(table) for h, inside in texts.grams(order)]))
        return replace(model, filter=_Answers(hashes, np.frombuffer(levels, np.uint8).astype(np.int64)))

    def tried(k: int, sent: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def fitted(table: pa.Table, answers: pa.Table) -> pa.Table:
            model = known(sent.value, table, answers)
            fits = [_last(model, texts, k).fits(_learnt(batch, trains)) for batch, texts in texts_of(table)]
            return pa.table({"weight": pa.array(WEIGHTS), "fit": pa.array(np.sum(fits, axis=0))})

        return fitted

    with Scratch(spark, "lm") as scratch:
        counts = scratch.cut(_counts(docs.where(train).select(F.col(text).alias("text")), 1), "counts")
        model = _of_tokens(counts, Filter(np.zeros((1, 1), np.uint8), (1, 1)), common_tokens)
        shipped = by_home.applyInArrow(ship, "bucket long, home long, grams long, hashes binary, counts binary")
        answered = scratch.cut(shipped.groupBy("bucket").applyInArrow(answer, "of_home long, bucket long, levels binary"), "answers")
        both = by_home.cogroup(answered.groupBy("of_home"))
        for k in range(2, order):
            sent = _sent(spark, model)
            model = _weighed(model, both.applyInArrow(tried(k, sent), "weight double, fit double"))
            sent.destroy()
        scorer = _Scorer(docs, model, order, keep, trains, names)

        def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
            model = known(scorer.sent.value, table, answers)
            return pa.Table.from_batches([scorer.scored(model, batch, texts) for batch, texts in texts_of(table)])

        return scorer.finished(both.applyInArrow(scored, scorer.schema), model)


def _check(keep: list[str], names: tuple[str, ...]) -> None:
    if {c.lower() for c in keep} & set(map(str.lower, names)):
        raise ValueError(f"the kept columns have one named as one of {names}")


class _Scorer:
    """Scores pieces of texts; if the model has no weight of the last order, under each of `WEIGHTS`."""

    def __init__(self, docs: DataFrame, model: Model, order: int, keep: list[str], trains: str, names: tuple[str, str, str, str, str]) -> None:
        self.sent = _sent(docs.sparkSession, model)
        self.order, self.keep, self.trains, self.names = order, keep, trains, names
        self.rare, self.row, self.fits = (fresh(c, keep, names) for c in ("rare", "row", "fits"))
        self.known_weights = len(model.weights) >= order - 1
        self.tried = (model.weights[order - 2:order - 1] or [1.0]) if self.known_weights else WEIGHTS
        kept = docs.select(*keep).schema
        self.kept = [f.name for f in kept]
        n_tokens, n_known, _, base, likely = names
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        self.schema = f"{fields + ', ' if fields else ''}`{n_tokens}` long, `{n_known}` long, `{base}` double, `{likely}` array<double>, `{self.fits}` array<double>, `{self.rare}` array<struct<token: string, n: long>>"

    def scored(self, model: Model, batch: pa.RecordBatch, texts: _Texts) -> pa.RecordBatch:
        n_tokens, n_known, _, base, likely = self.names
        end = model.train_texts
        last = _last(model, texts, self.order)
        total = np.column_stack([last.log10(w) for w in self.tried])
        # The first row of some texts has the sums of all of them.
        fitted = [None] * texts.n_texts
        if not self.known_weights:
            fitted[0] = last.fits(_learnt(batch, self.trains))
        n, known = model.exact(texts)
        text = texts.text[texts.word]
        logs = np.bincount(text, weights=np.log10(n + 1)[texts.token], minlength=texts.n_texts) + np.log10(end + 1)
        found = np.bincount(text, weights=known[texts.token], minlength=texts.n_texts).astype(np.int64) + (end > 0)
        # What is not at hand, by text and token.
        left = ~known[texts.token]
        pair = pa.array(text[left] * max(len(texts.spelling), 1) + texts.token[left]).value_counts()
        value = pair.field("values").to_numpy()
        by_text = np.argsort(value, kind="stable")
        value, times = value[by_text], pair.field("counts").to_numpy()[by_text]
        bounds = np.searchsorted(value // max(len(texts.spelling), 1), np.arange(texts.n_texts + 1))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
            [texts.spelling.take(pa.array(value % max(len(texts.spelling), 1))).cast(pa.string()), pa.array(times, pa.int64())], names=["token", "n"],
        ))
        columns = {name: batch.column(k) for k, name in enumerate(self.kept)}
        columns |= {
            n_tokens: pa.array(texts.words_of + 1, pa.int64()), n_known: pa.array(found, pa.int64()),
            base: pa.array(logs), likely: pa.FixedSizeListArray.from_arrays(total.ravel(), len(self.tried)).cast(pa.list_(pa.float64())),
            self.fits: pa.array(fitted, pa.list_(pa.float64())), self.rare: lists,
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def finished(self, scored: DataFrame, model: Model) -> DataFrame:
        """The scores under the best weight, with the tokens whose counts were not at hand."""
        n_tokens, n_known, train_tokens, base, likely = self.names
        rare, row, fits = self.rare, self.row, self.fits
        rows = cut(scored.withColumn(row, F.monotonically_increasing_id()), "lm-scored")
        best = 0
        if not self.known_weights:
            sums = rows.where(F.col(fits).isNotNull()).select(F.posexplode(fits).alias("at", "fit")).groupBy("at").agg(F.sum("fit").alias("fit")).collect()
            best = max(sums, key=lambda r: (r["fit"], -r["at"]))["at"] if sums else 0
        pairs = rows.select(F.col(row).alias("of_row"), F.explode(rare).alias("pair")).select("of_row", "pair.token", F.col("pair.n").alias("times"))
        more = pairs.join(model.rare, "token").groupBy("of_row").agg(
            F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("times").alias("more_known"),
        )
        joined = rows.join(more, rows[row] == more["of_row"], "left")
        each = float(np.log10(model.train_tokens + model.distinct + 1))
        return joined.select(
            *[rows[c] for c in self.keep], rows[n_tokens], (rows[n_known] + F.coalesce("more_known", F.lit(0))).alias(n_known),
            F.lit(model.train_tokens).cast("long").alias(train_tokens),
            (rows[base] + F.coalesce("more_logs", F.lit(0.0)) - rows[n_tokens] * each).alias(base), rows[likely][best].alias(likely),
        )


def _score(docs: DataFrame, model: Model, order: int, train: Column | None, keep: list[str], text: str, names: tuple[str, str, str, str, str]) -> DataFrame:
    """`score`; if the model has no weight of the last order, that which fits the texts of `train` best."""
    # Beside a kept column of the same name the text is read under another.
    read, trains = fresh("text", keep), fresh("trains", keep, names)
    scorer = _Scorer(docs, model, order, keep, trains, names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, read, _SCORED_BYTES):
            yield scorer.scored(scorer.sent.value, batch, texts)

    training = F.lit(False) if train is None else F.coalesce(train, F.lit(False))
    read_rows = docs.select(*keep, F.col(text).alias(read), training.alias(trains))
    return scorer.finished(read_rows.mapInArrow(scored, scorer.schema), model)
