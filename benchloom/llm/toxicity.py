"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled set is any training text, toxic ones
among it. A linear model on the presence of words and word beginnings minimizes
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),
the risk of a classifier of toxic against clean, as far as positives, unlabelled texts and the share
of toxic ones tell. When the second term would fall below zero, its gradient is turned round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from benchloom.llm.arrays import BYTE_HASH, PLAIN, U64, WORD_STEP, Words, mix, pieces, powers, words
from benchloom.llm.frames import fresh, sample
from benchloom.storage import cut

# Most training texts of each kind: bounds of what is fitted, not of what is scored.
POSITIVES = 6_000
UNLABELLED = 12_000
# A feature must occur in this share of the positives of one task.
LEAST_SHARE = 0.005
MOST_FEATURES = 20_000
# A feature is used if it is so many times as frequent among positives as among unlabelled texts,
# and by so many standard errors.
LEAST_LIFT, LEAST_ERRORS = 2.0, 3.0
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
_TASKS = 4
_FILTER_BITS = 20


def features(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word and word beginning."""
    row = found.text_of()
    rows, hashes = [row], [found.hashes]
    lengths = found.ends - found.starts
    rolled = np.zeros(len(lengths), U64)
    steps = powers(WORD_STEP, max(BEGINNINGS))
    for k in range(max(BEGINNINGS)):
        long = np.flatnonzero(lengths > k)
        rolled[long] += BYTE_HASH[found.flat[found.starts[long] + k]] * steps[k]
        if k + 1 in BEGINNINGS:
            rows.append(row[long])
            hashes.append(mix(rolled[long] ^ U64(0xA5A5 + k)))
    return np.concatenate(rows), np.concatenate(hashes)


class Vocabulary:
    """Looks feature hashes up; a bit table turns most of the others away first."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.may = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.may[self.hashes >> U64(64 - _FILTER_BITS)] = True

    def present(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature number) pairs."""
        row, hashes = features(found)
        maybe = np.flatnonzero(self.may[hashes >> U64(64 - _FILTER_BITS)])
        row, hashes = row[maybe], hashes[maybe]
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[place] == hashes
        pairs = np.unique(row[same] * len(self.hashes) + place[same])
        return pairs // len(self.hashes), pairs % len(self.hashes)


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float

    def scores(self, found: Words) -> np.ndarray:
        row, feature = self.vocabulary.present(found)
        margin = self.bias + np.bincount(row, self.weights[feature], minlength=len(found.first) - 1)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def nn_pu_fit(
    positives: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], width: int, prior: float,
    epochs: int = 300, rate: float = 0.05, sparsity: float = 1e-4, bias: float = -1.0,
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk.

    The loss is the sigmoid of the wrong margin: it is bounded, so a toxic text among the unlabelled
    costs no more than the prior takes off again. Both sets come as (row numbers, feature
    numbers, rows). `sparsity` is the penalty on absolute weights.
    """
    weights = np.zeros(width)
    first, second = np.zeros(width + 1), np.zeros(width + 1)

    def toxic(data):
        margin = bias + np.bincount(data[0], weights[data[1]], minlength=data[2])
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def slope(data, per_row):
        return np.concatenate((np.bincount(data[1], per_row[data[0]], minlength=width), [per_row.sum()])) / max(data[2], 1)

    for step in range(1, epochs + 1):
        p, u = toxic(positives), toxic(unlabelled)
        negative_risk = u.mean() - prior * p.mean()
        missed = prior * slope(positives, p * (1 - p))
        negative = slope(unlabelled, u * (1 - u)) - missed
        gradient = -negative if negative_risk < 0 else negative - missed
        gradient[:-1] += sparsity * np.sign(weights)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel | None:
    """A model from the given training rows; None if no labelled text is toxic.

    Positives are texts labelled 1, unlabelled ones any; both are samples of bounded size, chosen by a
    hash of the id. The prior is the share of 1 among all labelled texts. Labels of unknown
    documents, NULL labels and labels that contradict each other for one id (the
    higher holds) do no harm; the texts of labels 0 are used as unlabelled only.
    """
    known = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("of")).agg(F.max(toxic).alias("y"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # Ids meet labels first; only the bounded sample of ids then goes to the texts, which stay in place.
    labelled = cut(texts.select("id").join(known, F.col("id") == F.col("of")).groupBy("id").agg(F.max("y").alias("y")), "toxicity-labels")
    counts = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p")).first()
    if not counts["p"]:
        return None
    prior = min(max(counts["p"] / counts["n"], 1e-4), 0.9)
    named = sample(labelled.where("y = 1").select("id"), POSITIVES, "positives", "id")
    positives = sample(texts.join(F.broadcast(named), "id"), 2 * POSITIVES, "rows", "id", "text")
    others = sample(texts, UNLABELLED, "unlabelled", "id", "text")
    chosen = cut(positives.withColumn("p", F.lit(True)).union(others.withColumn("p", F.lit(False))), "toxicity-sample")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        texts_seen, uniques, counts = 0, [], []
        for whole in batches:
            for lo, hi in pieces(whole.column("text")):
                found = words(whole.column("text").slice(lo, hi - lo), PLAIN)
                row, hashes = features(found)
                order = np.lexsort((row, hashes))
                new = np.concatenate(([True], (np.diff(hashes[order]) != 0) | (np.diff(row[order]) != 0))) if len(order) else np.zeros(0, bool)
                unique, n = np.unique(hashes[order][new], return_counts=True)
                uniques.append(unique)
                counts.append(n)
                texts_seen += hi - lo
        if texts_seen:
            all_hashes, inverse = np.unique(np.concatenate(uniques), return_inverse=True)
            totals = np.bincount(inverse, np.concatenate(counts), minlength=len(all_hashes))
            keep = totals >= max(2, LEAST_SHARE * texts_seen)
            yield pa.RecordBatch.from_arrays([pa.array(all_hashes[keep].view(np.int64)), pa.array(totals[keep].astype(np.int64))], names=["h", "n"])

    seen = chosen.where("p").select("text").repartition(_TASKS, F.xxhash64("text")).mapInArrow(frequent, "h long, n long")
    top = seen.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MOST_FEATURES).toPandas()
    vocabulary = Vocabulary(top["h"].to_numpy(np.int64).view(U64))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column("text")):
                found = words(whole.column("text").slice(lo, hi - lo), PLAIN)
                row, feature = vocabulary.present(found)
                lists = np.split(feature.astype(np.uint16), np.searchsorted(row, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([whole.column("p").slice(lo, hi - lo), pa.array([x.tobytes() for x in lists], pa.binary())], names=["p", "v"])

    table = cut(chosen.mapInArrow(vectors, "p boolean, v binary"), "toxicity-vectors")
    width = len(vocabulary.hashes)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts = np.zeros(2, np.int64), np.zeros((2, width), np.int64)
        for batch in batches:
            for positive, v in zip(batch.column("p").to_pylist(), batch.column("v").to_pylist(), strict=True):
                rows[int(positive)] += 1
                counts[int(positive), np.frombuffer(v, np.uint16)] += 1
        # Feature -1 counts the texts.
        for kind in np.flatnonzero(rows):
            filled = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(filled) + 1, bool(kind))), pa.array(np.concatenate(([-1], filled))), pa.array(np.concatenate(([rows[kind]], counts[kind][filled]))),
            ], names=["p", "feature", "n"])

    found = table.mapInArrow(frequencies, "p boolean, feature long, n long").groupBy("p", "feature").agg(F.sum("n").alias("n")).toPandas()
    totals, often = np.zeros(2, np.int64), np.zeros((2, width))
    for p, part in found.groupby("p"):
        counts = part.set_index("feature")["n"]
        totals[int(p)] = counts.pop(-1)
        often[int(p), counts.index.to_numpy()] = counts.to_numpy()
    kept = _lifted(often[1], int(totals[1]), often[0], int(totals[0]))
    number = np.cumsum(kept) - 1

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(v, np.uint16) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array([number[x[kept[x]]].astype(np.uint16).tobytes() for x in lists], pa.binary())], names=["p", "v"])

    # The driver holds no features but those that are used. Order decides how sums round; sorted rows make a rerun give the same model.
    used = table.mapInArrow(reduced, "p boolean, v binary").orderBy("p", "v").toPandas()

    def rows(part: pd.Series) -> tuple[np.ndarray, np.ndarray, int]:
        lengths = part.str.len().to_numpy(np.int64) // 2
        return np.repeat(np.arange(len(part), dtype=np.int32), lengths), np.frombuffer(b"".join(part), np.uint16), len(part)

    weights, bias = nn_pu_fit(rows(used["v"][used["p"]]), rows(used["v"][~used["p"]]), int(kept.sum()), prior)
    return ToxicityModel(Vocabulary(vocabulary.hashes[kept]), weights, bias)


def _lifted(positive: np.ndarray, positives: int, unlabelled: np.ndarray, others: int) -> np.ndarray:
    """Which features are clearly more frequent among positives than among unlabelled texts, from the texts that have each."""
    p, u = positive / max(positives, 1), unlabelled / max(others, 1)
    pooled = (p * positives + u * others) / (positives + others)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / max(positives, 1) + 1 / max(others, 1)))
    return (p >= LEAST_LIFT * u) & (p - u >= LEAST_ERRORS * error)


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the toxicity of each whole text, from 0 to 1, in a new column.

    NULL and empty texts have no features and get the score of the bias. Without a
    model every score is 0. Repeated texts get the same score.
    """
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the documents have a column named {name}")
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column(text)):
                batch = whole.slice(lo, hi - lo)
                values = known.value.scores(words(batch.column(text), PLAIN))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, docs.select("*", F.lit(0.0).alias(name)).schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below the threshold, with the columns they came with."""
    name = fresh("toxicity", docs.columns)
    return score(docs, model, text, name).where(F.col(name) < threshold).drop(name)
