"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

Both start from the labelled documents. In each round either one labels the unlabelled documents it is
surest of, in the proportion of the labels, and these join the training set of the other. In
the end both are calibrated on labelled documents that took no part in training, and the calibrated log
odds are combined by a third fit on the same documents.

The text view sees content and form: words, word pairs and strings of GRAM bytes in hashed slots, and shares of marks and the like.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from benchloom.llm.arrays import PLAIN, SPACED, U64, mix, pieces, text_bytes, words
from benchloom.llm.frames import fresh, sample
from benchloom.storage import cut

# Most labelled and unlabelled documents that are fitted on; every document is scored.
LABELLED, UNLABELLED = 12_000, 24_000
ROUNDS, SHARE = 4, 0.05
# Times the odds of any document at which a view is sure.
SURE = 8.0
CALIBRATION = 4  # one labelled document in so many calibrates
THRESHOLD = 0.5
_SOURCES, _LANGS = 64, 32
_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
TEXT_WIDTH = len(_MARKS) + 10
# Slots of words and pairs, and as many of strings of GRAM bytes; a byte holds the level of one of each, from 0 to 15.
SLOTS, GRAM = 2048, 5
_LEVELS = np.minimum(np.round(3 * np.log1p(np.arange(256))), 15).astype(np.uint8)
# Length of each content row before its fit with a penalty of 1.
_GAIN = 4.0
_PIECE_ROWS = 128


def text_features(column: pa.Array) -> np.ndarray:
    """Form of a text: shares of marks, capitals, digits and line ends, word lengths, repeated words. Zeros without words."""
    found = words(column, SPACED)
    n = len(found.first) - 1
    lengths = np.diff(np.concatenate(([0], np.cumsum(np.bincount(found.text_of(), (found.ends - found.starts).astype(float), minlength=n)))))
    out = np.zeros((n, TEXT_WIDTH), np.float32)
    counts = found.counts().astype(float)
    filled = counts > 0
    row = found.text_of()
    # Bytes of words with the text they are in.
    size = found.ends - found.starts
    of_byte = np.repeat(row, size)
    at = np.repeat(found.starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    byte = found.flat[at]
    table = np.bincount(of_byte * 256 + byte, minlength=n * 256).reshape(n, 256).astype(float)
    total = np.maximum(lengths, 1)[:, None]
    out[:, :len(_MARKS)] = np.log1p(1000 * table[:, _MARKS] / total)
    k = len(_MARKS)
    out[:, k] = (table[:, 65:91].sum(axis=1) / total[:, 0])
    out[:, k + 1] = (table[:, 48:58].sum(axis=1) / total[:, 0])
    out[:, k + 2] = (table[:, 128:].sum(axis=1) / total[:, 0])
    out[:, k + 3] = np.log1p(counts)
    out[:, k + 4] = lengths / np.maximum(counts, 1)
    same = np.concatenate(([False], found.hashes[1:] == found.hashes[:-1])) if len(found.hashes) else np.zeros(0, bool)
    same[found.first[:-1][filled]] = False
    out[:, k + 5] = np.bincount(row, same, minlength=n) / np.maximum(counts, 1)
    key = mix(found.hashes ^ mix(row.astype(U64) + U64(1)))
    _, first = np.unique(key, return_index=True)
    out[:, k + 6] = np.bincount(row[first], minlength=n) / np.maximum(counts, 1)
    out[:, k + 7] = np.bincount(row, size > 20, minlength=n) / np.maximum(counts, 1)
    out[:, k + 8] = np.bincount(row, size < 2, minlength=n) / np.maximum(counts, 1)
    out[:, k + 9] = filled
    return out


def content_features(column: pa.Array) -> np.ndarray:
    """Levels of the slots of words and pairs (low halves of the bytes) and of strings of GRAM bytes (high halves)."""
    out = np.zeros((len(column), SLOTS), np.uint8)
    for lo, hi in pieces(column, rows=_PIECE_ROWS):
        part = column.slice(lo, hi - lo)
        found = words(part, PLAIN)
        n = hi - lo
        row = found.text_of()
        pair_at, pairs = found.windows(2)
        at = np.concatenate((row, row[pair_at])) * SLOTS + (np.concatenate((mix(found.hashes), pairs)) % U64(SLOTS)).astype(np.int64)
        level = _LEVELS[np.minimum(np.bincount(at, minlength=n * SLOTS), 255)]
        flat, bounds = text_bytes(part)
        last = max(len(flat) - GRAM + 1, 0)
        rolled = np.zeros(last, U64)
        for k in range(GRAM):
            rolled = rolled * U64(257) + PLAIN.written[flat[k:last + k]]
        row = np.repeat(np.arange(n), np.diff(bounds))
        inside = row[:last] == row[GRAM - 1:GRAM - 1 + last]
        at = row[:last][inside] * SLOTS + (mix(rolled[inside]) % U64(SLOTS)).astype(np.int64)
        level |= _LEVELS[np.minimum(np.bincount(at, minlength=n * SLOTS), 255)] << 4
        out[lo:hi] = level.reshape(n, SLOTS)
    return out


def text_rows(column: pa.Array) -> np.ndarray:
    """The text view of each text as bytes: form, then content."""
    return np.concatenate((text_features(column).view(np.uint8), content_features(column)), axis=1)


def metadata_features(source: str, lang: str, n_chars: str) -> list[Column]:
    """Slots of source and language, and the logarithm of the stated length; NULLs have slots of their own."""
    size = F.coalesce(F.col(n_chars).cast("double"), F.lit(0.0)) if n_chars else F.lit(0.0)
    return [
        F.when(F.col(source).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(source), F.lit(_SOURCES - 1))).cast("int").alias("m_source"),
        F.when(F.col(lang).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(lang), F.lit(_LANGS - 1))).cast("int").alias("m_lang"),
        F.log1p(F.greatest(size, F.lit(0.0))).cast("float").alias("m_size"),
    ]


def _metadata(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(source), _SOURCES + _LANGS + 10), np.float32)
    out[np.arange(len(source)), source] = 1
    out[np.arange(len(source)), _SOURCES + lang] = 1
    steps = np.array([2, 3, 4, 5, 6, 7, 8, 9, 10], np.float32)
    out[:, _SOURCES + _LANGS] = size
    out[:, _SOURCES + _LANGS + 1:] = size[:, None] > steps
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.spread) @ self.weights + self.bias


def logistic(rows: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> Logistic:
    """Ridge logistic regression by Newton's method on standardized columns."""
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    x = np.column_stack(((rows - mean) / spread, np.ones(len(rows))))
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * len(rows))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, spread, w[:-1], float(w[-1]))


_AT_ONCE = 1024


def _form(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :TEXT_WIDTH * 4]).view(np.float32)


class _Content:
    """The content of some text rows as a matrix of unit rows, unpacked a few rows at a time."""

    def __init__(self, rows: np.ndarray) -> None:
        self.packed = rows[:, TEXT_WIDTH * 4:]
        self.inverse = np.concatenate([self._norms(b) for _, b in self._blocks()]) if len(rows) else np.zeros((0, 2), np.float32)

    def _blocks(self) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        for a in range(0, len(self.packed), _AT_ONCE):
            part = self.packed[a:a + _AT_ONCE]
            yield a, ((part & 15).astype(np.float32), (part >> 4).astype(np.float32))

    @staticmethod
    def _norms(halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.column_stack([_GAIN / np.sqrt(np.maximum(np.einsum("ij,ij->i", h, h), 1)) for h in halves]).astype(np.float32)

    def times(self, w: np.ndarray) -> np.ndarray:
        out, halves = np.zeros(len(self.packed)), w.astype(np.float32).reshape(2, SLOTS)
        for a, block in self._blocks():
            out[a:a + _AT_ONCE] = sum((h @ v) * self.inverse[a:a + _AT_ONCE, k] for k, (h, v) in enumerate(zip(block, halves, strict=True)))
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros((2, SLOTS))
        for a, block in self._blocks():
            for k, h in enumerate(block):
                out[k] += (r[a:a + _AT_ONCE] * self.inverse[a:a + _AT_ONCE, k]).astype(np.float32) @ h
        return out.ravel()


@dataclass
class TextLogistic:
    form: Logistic
    content: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return self.form.margin(_form(rows)) + _Content(rows).times(self.content)


def text_logistic(rows: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 6, inner: int = 8) -> TextLogistic:
    """Ridge logistic regression on form and content, by Newton steps that conjugate gradients solve."""
    form, content = _form(rows), _Content(rows)
    mean, spread = form.mean(axis=0), form.std(axis=0) + 1e-3
    x = np.column_stack(((form - mean) / spread, np.ones(len(rows))))
    k = x.shape[1]
    penalty = np.concatenate((np.full(k, ridge * len(rows)), np.ones(2 * SLOTS)))
    penalty[k - 1] = 1e-6
    # From what form alone gives.
    start = logistic(form, y, ridge)
    w = np.concatenate((start.weights, [start.bias], np.zeros(2 * SLOTS)))

    def times(v: np.ndarray) -> np.ndarray:
        return x @ v[:k] + content.times(v[k:])

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate((x.T @ r, content.back(r)))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        weight = p * (1 - p) + 1e-6
        left = -(back(p - y) + penalty * w)
        scale = np.concatenate(((x * x).T @ weight, np.full(2 * SLOTS, _GAIN**2 * weight.sum() / SLOTS))) + penalty
        step, toward = np.zeros_like(w), left / scale
        now = float(left @ toward)
        for _ in range(inner):
            if now < 1e-10:
                break
            bent = back(weight * times(toward)) + penalty * toward
            size = now / float(toward @ bent)
            step += size * toward
            left = left - size * bent
            ready = left / scale
            before, now = now, float(left @ ready)
            toward = ready + now / before * toward
        w += np.clip(step, -5, 5)
    return TextLogistic(Logistic(mean, spread, w[:k - 1], float(w[k - 1])), w[k:])


@dataclass
class QualityModel:
    text: Logistic | TextLogistic
    page: Logistic
    text_scale: Logistic
    page_scale: Logistic
    both: Logistic

    def views(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the page view, and both."""
        a = self.text_scale.margin(self.text.margin(text)[:, None])
        b = self.page_scale.margin(self.page.margin(page)[:, None])
        c = self.both.margin(np.column_stack((a, b)))
        return tuple(1 / (1 + np.exp(-np.clip(m, -30, 30))) for m in (a, b, c))


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, more_text: np.ndarray, more_page: np.ndarray) -> QualityModel:
    """The rounds on numpy arrays: two views of labelled documents, and of unlabelled ones."""
    number = np.arange(len(y))
    check = number % CALIBRATION == 0
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check = np.zeros(len(y), bool)
    train = ~check
    share = min(max(float(y[train].mean()), 1e-3), 1 - 1e-3)
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view's classifier learns from
    views = ((text, more_text), (page, more_page))

    def fitted(view: int) -> Logistic:
        rows, pool = views[view]
        extra = np.array(sorted(given[view]), dtype=int)
        labels = np.array([given[view][i] for i in extra])
        # Text rows come as bytes.
        learn = text_logistic if rows.dtype == np.uint8 else logistic
        return learn(np.concatenate((rows[train], pool[extra])), np.concatenate((y[train], labels)))

    held = check if check.any() else train
    models = [fitted(0), fitted(1)]
    take = int(SHARE * len(more_text))
    prior = np.log(share / (1 - share))
    for _ in range(ROUNDS if take else 0):
        for view in (0, 1):
            margin = models[view].margin(views[view][1])
            # Odds as calibrated on documents of known label, against those of any document: a view that
            # knows nothing is never sure.
            odds = logistic(models[view].margin(views[view][0][held])[:, None], y[held]).margin(margin[:, None]) - prior
            order = np.argsort(odds, kind="stable")
            order = order[~np.isin(order, list(given[1 - view]))]
            low, high = order[:max(1, round(take * (1 - share)))], order[::-1][:max(1, round(take * share))]
            given[1 - view].update({int(i): 0.0 for i in low if odds[i] <= -np.log(SURE)})
            given[1 - view].update({int(i): 1.0 for i in high if odds[i] >= np.log(SURE)})
        models = [fitted(0), fitted(1)]
    margins = [models[v].margin(views[v][0][held]) for v in (0, 1)]
    scales = [logistic(m[:, None], y[held]) for m in margins]
    calibrated = np.column_stack([s.margin(m[:, None]) for s, m in zip(scales, margins, strict=True)])
    return QualityModel(models[0], models[1], scales[0], scales[1], logistic(calibrated, y[held]))


_ROWS = 2_000


def _featured(rows: DataFrame, keep: str) -> DataFrame:
    """Text features as bytes beside the metadata columns and `keep`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column("text"), rows=_ROWS):
                batch = whole.slice(lo, hi - lo)
                found = text_rows(batch.column("text"))
                arrays = [batch.column(c) for c in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), *arrays], names=["v", *batch.schema.names[1:]])

    return rows.select("text", "m_source", "m_lang", "m_size", keep).mapInArrow(run, f"v binary, m_source int, m_lang int, m_size float, {keep} double")


def _arrays(table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.empty((len(table), TEXT_WIDTH * 4 + SLOTS), np.uint8)
    for i, v in enumerate(table["v"]):
        text[i] = np.frombuffer(v, np.uint8)
    return text, _metadata(table["m_source"].to_numpy(), table["m_lang"].to_numpy(), table["m_size"].to_numpy())


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", n_chars: str = "n_chars", quality: str = "quality",
) -> QualityModel | None:
    """A model from the given training rows; None if the labels have not both classes.

    Labelled and unlabelled documents are samples of bounded size, chosen by a hash of the id. NULL labels
    do not count, contradicting ones count as the lower. NULL texts and metadata are values of their own.
    """
    known = labels.where(F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("of")).agg(F.min(quality).cast("double").alias("y"))
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *metadata_features(source, lang, n_chars))
    chosen = sample(cut(base.select("id").distinct().join(known, F.col("id") == F.col("of")).select("id", "y"), "quality-labels"), LABELLED, "labelled", "id")
    labelled = base.join(F.broadcast(chosen), "id")
    pool = sample(base, UNLABELLED, "pool", "id", "text").withColumn("y", F.lit(-1.0))
    # Sorted rows make a rerun fit the same model.
    table = _featured(labelled.select("text", "m_source", "m_lang", "m_size", "y").union(pool.select("text", "m_source", "m_lang", "m_size", "y")), "y").toPandas()
    table = table.sort_values(["y", "v", "m_source", "m_lang", "m_size"], kind="stable")
    shuffled = table.iloc[np.argsort(mix(np.arange(len(table), dtype=U64)), kind="stable")]
    told, untold = shuffled[shuffled["y"] >= 0], shuffled[shuffled["y"] < 0]
    if told["y"].nunique() < 2:
        return None
    return co_train(*_arrays(told), told["y"].to_numpy(), *_arrays(untold))


def score(
    docs: DataFrame, model: QualityModel | None, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
    names: tuple[str, str, str] = ("text_score", "page_score", "score"),
) -> DataFrame:
    """`docs` with the calibrated scores of both views and their combination, from 0 to 1, for every whole text.

    Without a model all scores are 0.5. Repeated rows get the same scores. Documents
    with a column named as a new one need other `names`.
    """
    if set(map(str.lower, names)) & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column named as one of {names}")
    if model is None:
        return docs.select("*", *[F.lit(0.5).alias(n) for n in names])
    known = docs.sparkSession.sparkContext.broadcast(model)
    extra = [fresh(f"m{i}", docs.columns, list(names)) for i in range(3)]
    marked = docs.select("*", *[c.alias(n) for c, n in zip(metadata_features(source, lang, n_chars), extra, strict=True)])
    schema = marked.select("*", *[F.lit(0.0).alias(n) for n in names]).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column(text), rows=_ROWS):
                batch = whole.slice(lo, hi - lo)
                page = _metadata(*[batch.column(batch.schema.get_field_index(e)).to_numpy(zero_copy_only=False) for e in extra])
                found = known.value.views(text_rows(batch.column(batch.schema.get_field_index(text))), page)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v.astype(np.float64)) for v in found]], names=[*batch.schema.names, *names])

    return marked.mapInArrow(scored, schema).drop(*extra)
