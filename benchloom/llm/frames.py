"""Small DataFrame helpers of the subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def fresh(name: str, *taken: list[str]) -> str:
    """`name`, with underscores added until no taken column has it, in any case."""
    known = {c.lower() for columns in taken for c in columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def held_out(doc_id: str = "doc_id", of: int = 4) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by `of`."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == 2, F.lit(False))


def parts_for(total: float, each: float) -> int:
    """Partitions for `total` of something, with about `each` in one; grows with the data, without a cap."""
    return max(1, math.ceil(total / each))


def text_total(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text).cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def sample(rows: DataFrame, most: int, seed: str, *by: str) -> DataFrame:
    """About `most` rows, or all if there are no more; the same rows each time, chosen by a hash of `by`."""
    total = rows.count()
    if total <= most:
        return rows
    draw = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30))
    return rows.where(draw < int(most / total * (1 << 30)))
