"""Words, hashes and windows of Arrow text batches as numpy arrays; small helpers that tasks share.

Texts are handled as UTF-8 bytes. Every separator used here is an ASCII byte, so bytes and
code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Bytes of text handled at a time inside a task; one longer text is a piece of its own.
PIECE_BYTES = 2 << 20

WORD_STEP = U64(0x9E3779B97F4A7C15)
WINDOW_STEP = U64(0xD6E8FEB86659FD93)
SECOND_STEP = U64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_HASH = mix((np.arange(256, dtype=U64) + U64(1)) * WORD_STEP)
# A value of its own for every byte at every place of a word. Sums of multiples of powers would do for hashes of
# few parts, but modulo 2**64 they are equal for some pairs of long words, whatever the factor.
_PLACES = 64
_PLACE_HASH = mix((np.arange(_PLACES * 256, dtype=U64) + U64(257)) * WORD_STEP)


def powers(step: np.uint64, n: int) -> np.ndarray:
    """1, step, step**2, ... modulo 2**64."""
    out = np.full(max(n, 1), step, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts and ends in them. NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(ends):
        ends = np.zeros(1, dtype=np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column, each of about `size` bytes of text or one long row, and of at most `rows` rows."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, length in enumerate(lengths):
        if row - first >= rows or (held and held + length > size):
            yield first, row
            first, held = row, 0
        held += int(length)
    if first < len(lengths):
        yield first, len(lengths)


@dataclass
class Alphabet:
    """Which bytes make words, and what each is written as."""

    in_word: np.ndarray
    written: np.ndarray


def _alphabet(in_word: np.ndarray, lower: bool) -> Alphabet:
    written = np.arange(256, dtype=np.uint8)
    if lower:
        written[ord("A"):ord("Z") + 1] += 32
    return Alphabet(in_word, written)


_ALL = np.arange(256)
# [^\x20\x09-\x0D]+
SPACED = _alphabet(~np.isin(_ALL, [0x20, *range(0x09, 0x0E)]), lower=False)
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
PLAIN = _alphabet(
    (_ALL >= 0x80) | ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A))
    | ((_ALL >= 0x41) & (_ALL <= 0x5A)), lower=True,
)


@dataclass
class Words:
    """The words of some texts: byte ranges, hashes, and the range of words of each text."""

    flat: np.ndarray  # bytes as written
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first word of each text, one entry more than texts
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.flat[self.starts[i]:self.ends[i]].tobytes()

    def joined(self, i: int, n: int) -> bytes:
        return b" ".join(self.word(k) for k in range(i, i + n))

    def windows(self, n: int, step: np.uint64 = WINDOW_STEP) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of n words that lies in one text."""
        m = len(self.hashes)
        if m < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        rolled = np.zeros(m - n + 1, dtype=U64)
        for k in range(n):
            rolled *= step
            rolled += self.hashes[k:m - n + 1 + k]
        last = np.repeat(self.first[1:], self.counts())[:m - n + 1]
        at = np.flatnonzero(np.arange(m - n + 1) + n <= last)
        return at, mix(rolled[at])


def words(column: pa.Array, alphabet: Alphabet, hashed: bool = True) -> Words:
    flat, bounds = text_bytes(column)
    inside = alphabet.in_word[flat]
    flat = alphabet.written[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(flat) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(flat) else inside
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, bounds)
    hashes = np.zeros(0, U64)
    if hashed and len(starts):
        lengths = ends - starts
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        spread = _PLACE_HASH[(place % _PLACES) * 256 + flat[inside]]
        far = np.flatnonzero(place >= _PLACES)
        spread[far] = mix(spread[far] + (place[far] // _PLACES).astype(U64) * WINDOW_STEP)
        hashes = mix(np.add.reduceat(spread, at) + lengths.astype(U64))
    return Words(flat, starts, ends, first, hashes)
