"""Language identification by the nearest centroid.

A text becomes the TF-IDF vector of its hashed byte trigrams, of length 1. Each language has a few
centroids, found by spherical k-means among its training texts; a text gets the language of
the centroid with the highest cosine. A text far from every centroid is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from benchloom.llm.arrays import pieces, text_bytes
from benchloom.llm.frames import fresh
from benchloom.storage import cut

# About the most training texts per language that centroids are fitted to.
TEXTS_PER_LANGUAGE = 1500
SLOTS = 4096
CENTROIDS = 4
# Share of a language's own training texts that lie beyond the distance of rejection.
REJECTED_SHARE = 0.005
UNKNOWN = "und"
_ROWS = 512

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigrams(column: pa.Array) -> np.ndarray:
    """Damped counts of hashed trigrams, one row per text. All but letters and non-ASCII bytes counts as a space."""
    flat, bounds = text_bytes(column)
    n = len(bounds) - 1
    letters = _LETTERS[flat].astype(np.uint32)
    if len(letters) < 3:
        return np.zeros((n, SLOTS), np.float32)
    code = letters[:-2] | letters[1:-1] << np.uint32(8) | letters[2:] << np.uint32(16)
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
    lengths = np.diff(bounds)
    row = np.repeat(np.arange(n), lengths)[:len(code)]
    inside = np.arange(len(code)) + 3 <= np.repeat(bounds[1:], lengths)[:len(code)]
    inside &= code != 0x202020
    counts = np.bincount(row[inside] * SLOTS + slot[inside], minlength=n * SLOTS).reshape(n, SLOTS)
    return np.log1p(counts).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def spherical_means(rows: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of unit rows by cosine. Starts from rows far from each other, so it needs no draw."""
    centers = [unit(rows.mean(axis=0, keepdims=True))[0]]
    near = rows @ centers[0]
    while len(centers) < min(k, len(rows)):
        centers.append(rows[int(np.argmin(near))])
        near = np.maximum(near, rows @ centers[-1])
    found = np.array(centers)
    for _ in range(rounds):
        mine = np.argmax(rows @ found.T, axis=1)
        for c in range(len(found)):
            if (mine == c).any():
                found[c] = rows[mine == c].mean(axis=0)
        found = unit(found)
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected, per language

    def cosines(self, column: pa.Array) -> np.ndarray:
        """Highest cosine per language, one row per text."""
        near = unit(trigrams(column) * self.idf) @ self.centroids.T
        out = np.full((len(near), len(self.languages)), -1.0, np.float32)
        for c, language in enumerate(self.language_of):
            out[:, language] = np.maximum(out[:, language], near[:, c])
        return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Centroids of each language of the given training rows; None if no row has both text and language.

    Document frequencies are those of all given texts. Centroids are fitted to about TEXTS_PER_LANGUAGE texts of each
    language at most, chosen by a hash of the id; rows that agree in id, text and language are one there. Every language is
    learnt, however rare: the model takes some 64 KB for each. Texts without a letter teach nothing.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for lo, hi in pieces(whole.column("text"), rows=_ROWS):
                total += (trigrams(whole.column("text").slice(lo, hi - lo)) > 0).sum(axis=0)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled])], names=["slot", "n"])

    keyed = F.xxhash64(F.lit("language"), "id", "text")
    # A row that is repeated counts once in the share to draw, or a language of such rows could be missed.
    distinct = known.groupBy("lang", keyed.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).orderBy("lang").toPandas()
    if counts.empty:
        return None
    frequencies = known.select("text").mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SLOTS, np.int64)
    df[frequencies["slot"]] = frequencies["n"]
    idf = (np.log((1 + counts["n"].sum()) / (1 + df)) + 0.05).astype(np.float32)
    draw = F.pmod(keyed, F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for n, c in zip(counts["lang"], counts["rows"], strict=True) for x in (n, min(1.0, TEXTS_PER_LANGUAGE / c))])
    chosen = known.where(draw < share[F.col("lang")] * (1 << 30)).dropDuplicates()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in pieces(whole.column("text"), rows=_ROWS):
                batch = whole.slice(lo, hi - lo)
                found = trigrams(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([row.tobytes() for row in found.astype(np.float16)], pa.binary())], names=["lang", "v"])

    rows = cut(chosen.mapInArrow(vectors, "lang string, v binary"), "language-sample")

    def clustered(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        mine = unit(np.array([np.frombuffer(v, np.float16) for v in frame["v"]]).astype(np.float32) * idf)
        centers = spherical_means(mine, CENTROIDS)
        least = float(np.quantile((mine @ centers.T).max(axis=1), REJECTED_SHARE))
        return pd.DataFrame({"lang": [keys[0]] * len(centers), "least": [least] * len(centers), "center": [c.astype(np.float32).tobytes() for c in centers]})

    found = rows.groupBy("lang").applyInPandas(clustered, "lang string, least double, center binary").orderBy("lang", "center").toPandas()
    languages = sorted(set(found["lang"]))
    return LanguageModel(
        languages, idf, np.array([np.frombuffer(c, np.float32) for c in found["center"]]),
        np.array([languages.index(x) for x in found["lang"]]),
        found.groupby("lang")["least"].first().loc[languages].to_numpy(),
    )


def identify(
    docs: DataFrame, model: LanguageModel | None, text: str = "text", reject: bool = True,
    names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """`docs` with predicted language, cosine to its nearest centroid from 0 to 1, and whether that is too far.

    A NULL text, one without a letter, or any text without a model is `und` with score 0. A rejected
    text is `und` as well, unless `reject` is off. Repeated rows get the same answer.
    Documents with a column named as a new one need other `names`.
    """
    predicted, score, rejected = names
    if set(map(str.lower, names)) & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column named as one of {names}")
    letter = fresh("has_letter", docs.columns, list(names))
    marked = docs.select("*", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter))
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias(predicted), F.lit(0.0).alias(score), F.lit(True).alias(rejected))
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = marked.select("*", F.lit("").alias(predicted), F.lit(0.0).alias(score), F.lit(False).alias(rejected)).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = known.value
        for whole in batches:
            for lo, hi in pieces(whole.column(text), rows=_ROWS):
                batch = whole.slice(lo, hi - lo)
                near = fitted.cosines(batch.column(text))
                best = near.argmax(axis=1)
                top = np.clip(near.max(axis=1), 0, 1).astype(np.float64)
                lettered = batch.column(batch.schema.get_field_index(letter)).to_numpy(zero_copy_only=False).astype(bool)
                far = ~lettered | (top < fitted.least[best])
                unknown = ~lettered | (far & reject)
                named = [UNKNOWN if u else fitted.languages[b] for u, b in zip(unknown, best, strict=True)]
                arrays = [*batch.columns, pa.array(named, pa.string()), pa.array(np.where(lettered, top, 0.0)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

    return marked.mapInArrow(predict, schema).drop(letter)
