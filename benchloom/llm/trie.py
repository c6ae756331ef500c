"""Prefix trie of conversations, from double-array tries of shards.

A turn is named by 128 bits of the SHA-256 of its role and text. A conversation is cut into segments of `SEGMENT` turns, so
that none is too long for a task; what lies before a segment is named by a sum of hashes of the segments before it, which
several tasks can add up. Equal segments after equal turns are one sequence. The sequences of one tier (first segments,
second segments, ...) are range-partitioned in their order, so each partition is a shard of neighbouring prefixes,
whatever prefix is common. A task numbers the turns of its shard densely, packs BASE and CHECK arrays and walks its
sequences through them, which gives the nodes. Only those on the way to the first or the last sequence of a shard can lie
in other shards too; these are merged by name, and what they hold is added up over all shards.

Tiers are taken from the deepest that two conversations share; segments that only one conversation has are chains and
need no trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from benchloom.llm.frames import parts_for
from benchloom.storage import Scratch, cut

SEGMENT = 128
# Sequences of a shard.
SHARD_SEQUENCES = 20_000
# Parents with more children than this are placed behind all others, without looking for a gap.
_FEW = 64
_GAPS = 2048
_CHUNK_IDS = 100_000

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_LANES = range(4)
_NODE = (
    "prefix string, digest string, depth long, conv_id long, parent_conv_id long, parent_digest string, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, n_end long, upper boolean, words long, ancestors array<string>"
)


def _in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows in range partitions of (key, order), with the partition as `slice` and a rising number as `at`."""
    return (
        rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
        .withColumn("slice", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    )


def _before(key: str) -> Window:
    """The earlier slices of a key."""
    return Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, place, turn_key, words) of every turn; places count from 1 within a conversation, however long it is.

    Turns are in order of `turn`, NULL first; equal ones in order of their keys. NULL roles and texts are empty. Rows without
    a conversation are left out; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(32))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), named.alias("turn_key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    placed = scratch.cut(_in_order(rows, "conv_id", "turn", "turn_key"), "placed")
    slices = placed.groupBy("conv_id", "slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    shift = slices.select("conv_id", "slice", (F.coalesce(F.sum("n").over(_before("conv_id")), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return scratch.cut(
        placed.join(shift, ["conv_id", "slice"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "turn_key", "words"), "turns",
    )


def grafted(turns: DataFrame, members: DataFrame, scratch: Scratch, every: int = 20, most: int = 4) -> DataFrame:
    """Turns of the conversations `members`, each with its first h turns replaced by those of another.

    h is the crc32 of the decimal id modulo `most`; the other is the conversation whose id is c - c % every. If that has
    fewer turns, all of them are taken; if it does not exist, none.
    """
    first = turns.where((F.col("place") < most) & (F.col("conv_id") % every == 0)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "turn_key", "words"))).alias("first")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    plan = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h")).join(first, "base", "left")
    taken = F.filter(F.coalesce("first", F.array().cast("array<struct<place: long, turn_key: string, words: long>>")), lambda t: t["place"] <= F.col("h"))
    plan = scratch.cut(plan.select("conv_id", "h", taken.alias("taken")), "grafts")
    heads = plan.select("conv_id", F.inline("taken"))
    rest = turns.join(plan.select("conv_id", "h", F.size("taken").alias("n_taken")), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("n_taken")).alias("place"), "turn_key", "words",
    )
    return scratch.cut(heads.unionByName(rest), "grafted")


class DoubleArray:
    """Trie over codes from 1: the child of state s by code c is BASE[s] + c if CHECK there is s."""

    def __init__(self, roots: int, codes: int) -> None:
        self.base = np.zeros(2 * (roots + codes) + 64, dtype=np.int64)
        self.check = np.full(len(self.base), -1, dtype=np.int64)
        # States 0 .. roots - 1 are roots; no child lies there, and behind `top` nothing lies.
        self.check[:roots] = -2
        self.low, self.top = roots, roots + codes + 1

    def _reach(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate((self.base, np.zeros(more, dtype=np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, dtype=np.int64)))

    def _gap(self, codes: np.ndarray) -> int:
        """A base under which all places are free, in the gaps so far if there is one in sight."""
        self._reach(self.top + int(codes[-1]) + 1)
        if len(codes) <= _FEW:
            for at in range(self.low, min(self.low + 16 * _GAPS, self.top), _GAPS):
                free = np.flatnonzero(self.check[at:min(at + _GAPS, self.top)] == -1) + at
                if at == self.low and len(free) < _GAPS // 16:
                    self.low += _GAPS
                fits = (self.check[free[:, None] - codes[0] + codes[None, :]] == -1).all(axis=1)
                if fits.any():
                    return int(free[fits.argmax()] - codes[0])
        return int(self.top - codes[0])

    def add(self, states: np.ndarray, codes: np.ndarray) -> None:
        """Children of states that have none yet; pairs are unique and in order."""
        first = np.flatnonzero(np.concatenate(([True], states[1:] != states[:-1])))
        size = np.diff(np.concatenate((first, [len(states)])))
        for at, many in zip(first[size > 1], size[size > 1], strict=True):
            own = codes[at:at + many]
            base = self._gap(own)
            self.base[states[at]] = base
            self.check[base + own] = states[at]
            self.top = max(self.top, base + int(own[-1]) + 1)
        alone = first[size == 1]
        self._reach(self.top + len(alone))
        slots = self.top + np.arange(len(alone))
        self.base[states[alone]] = slots - codes[alone]
        self.check[slots] = states[alone]
        self.top += len(alone)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each state by its code, -1 if it has none."""
        at = self.base[states] + codes
        # A base may be below zero.
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def _packed(roots: np.ndarray, codes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of sequences that begin at given roots, packed depth by depth."""
    many = int(codes.max(initial=0)) + 1
    trie = DoubleArray(int(roots.max()) + 1, many)
    state = roots.copy()
    for depth in range(int(lengths.max())):
        has = np.flatnonzero(lengths > depth)
        code = codes[first[has] + depth]
        pairs = np.unique(state[has] * many + code)
        trie.add(pairs // many, pairs % many)
        state[has] = trie.step(state[has], code)
    return trie


def _dense(turns: pa.Array, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of the turns from 1, by depth and then by sequence: children of one node get near numbers, which pack well."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((row, np.arange(len(row)) - first[row]))
    codes = np.empty(len(row), dtype=np.int64)
    codes[order] = turns.take(pa.array(order)).dictionary_encode().indices.to_numpy()
    return codes + 1


def _shard_nodes(table: pa.Table, above: int) -> pa.RecordBatch:
    """Nodes of a shard of sequences, in order of prefix and path. `above` is the depth of its roots."""
    prefix = table["prefix"].combine_chunks().dictionary_encode()
    roots = prefix.indices.to_numpy().astype(np.int64)
    n_roots = len(prefix.dictionary)
    paths = table["path"].combine_chunks()
    lengths = paths.value_lengths().to_numpy().astype(np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    turns = paths.flatten()
    codes = _dense(turns, first, lengths)
    words = table["words"].combine_chunks().flatten().to_numpy()
    n, ids, n_end = (table[c].to_numpy() for c in ("n", "first_id", "n_end"))
    trie = _packed(roots, codes, first, lengths)
    size = max(trie.top, n_roots)
    n_convs, ends, depth, root_of, word = (np.zeros(size, dtype=np.int64) for _ in range(5))
    conv = np.full(size, np.iinfo(np.int64).max)
    below = {c: np.zeros(size, dtype=np.int64) for c in ("children", "leaves", "saved")}
    upper, alive = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    # What lies on the way to the first and the last sequence of the shard may be in other shards too.
    low, high = 0, len(lengths) - 1
    state, digest = roots.copy(), {}
    for at in range(int(lengths.max(initial=0)) + 1):
        has = np.flatnonzero(lengths >= at)
        if at:
            state[has] = trie.step(state[has], codes[first[has] + at - 1])
            word[state[has]] = words[first[has] + at - 1]
        np.add.at(n_convs, state[has], n[has])
        np.minimum.at(conv, state[has], ids[has])
        depth[state[has]], root_of[state[has]], alive[state[has]] = at, roots[has], True
        for i in (low, high):
            if lengths[i] >= at:
                upper[state[i]] = True
                digest[int(state[i])] = hashlib.sha256("".join(turns[int(first[i]):int(first[i]) + at].to_pylist()).encode()).hexdigest()
    upper[:n_roots] = True
    digest |= {r: EMPTY_SHA256 for r in range(n_roots)}
    ends[state] = n_end
    for column, name in (("children", "next_children"), ("leaves", "next_leaves"), ("saved", "next_saved")):
        below[column][state] = table[name].to_numpy()
    children, leaves, saved = below["children"].copy(), below["leaves"].copy(), below["saved"].copy()
    nodes = np.flatnonzero(alive)
    for at in range(int(depth.max(initial=0)), -1, -1):
        here = nodes[(depth[nodes] == at) & ~upper[nodes]]
        leaves[here] += children[here] == 0
        saved[here] += (n_convs[here] - 1) * word[here]
        if at:
            parent = trie.check[here]
            np.add.at(children, parent, 1)
            np.add.at(leaves, parent, leaves[here])
            np.add.at(saved, parent, saved[here])
    parent = np.where(depth[nodes] > 0, trie.check[nodes], -1)
    under = (parent >= 0) & upper[parent]
    at_end = {int(s): d for s, d, e in zip(state, table["digest"].to_pylist(), n_end, strict=True) if e}
    listing, ancestors = nodes.tolist(), {}
    for s in np.flatnonzero(upper & alive):  # along two paths and over the roots
        line, up = [], int(s)
        while depth[up] > 0:
            up = int(trie.check[up])
            line.append(digest[up])
        ancestors[int(s)] = line
    columns = {
        "prefix": prefix.dictionary.take(pa.array(root_of[nodes])).cast(pa.string()),
        "digest": pa.array([digest.get(s) or at_end.get(s) for s in listing], pa.string()),
        "depth": pa.array(depth[nodes] + above), "conv_id": pa.array(conv[nodes]),
        "parent_conv_id": pa.array(conv[parent], mask=under | (parent < 0)),
        "parent_digest": pa.array([digest[p] if u else None for p, u in zip(parent.tolist(), under, strict=True)], pa.string()),
        "n_convs": pa.array(n_convs[nodes]), "n_children": pa.array(children[nodes]), "n_leaves": pa.array(leaves[nodes]),
        "saved_tokens": pa.array(saved[nodes]), "n_end": pa.array(ends[nodes]), "upper": pa.array(upper[nodes]), "words": pa.array(word[nodes]),
        "ancestors": pa.array([ancestors.get(s) for s in listing], pa.list_(pa.string())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _tier_nodes(sequences: DataFrame, tier: int, ahead: DataFrame, segment: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes of the sequences of one tier, and (prefix, children, leaves, saved) of its roots.

    Below the first tier a root is a node of the tier before, some of whose members may end there: `ahead` has its
    smallest (tier, prefix, before_id).
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield _shard_nodes(pa.Table.from_batches(held), tier * segment)

    parts = parts_for(sequences.count(), SHARD_SEQUENCES)
    nodes = scratch.cut(sequences.repartitionByRange(parts, "prefix", "path").sortWithinPartitions("prefix", "path").mapInArrow(packed, _NODE), "nodes")
    sums = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_end")}
    firsts = {c: F.first(c).alias(c) for c in ("depth", "parent_digest", "words", "ancestors")}
    merged = scratch.cut(
        nodes.where("upper").groupBy("prefix", "digest").agg(F.min("conv_id").alias("conv_id"), *sums.values(), *firsts.values()), "merged",
    )
    # Children that are merged themselves.
    more = merged.where("parent_digest IS NOT NULL").groupBy("prefix", F.col("parent_digest").alias("digest")).agg(F.count("*").alias("more"))
    merged = scratch.cut(
        merged.join(more, ["prefix", "digest"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"), "families",
    )
    held = merged.select(
        "prefix", F.explode(F.concat(F.array("digest"), "ancestors")).alias("digest"),
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    ).groupBy("prefix", "digest").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    merged = scratch.cut(merged.drop("n_leaves", "saved_tokens").join(held, ["prefix", "digest"]), "totals")
    roots = merged.where(F.col("digest") == EMPTY_SHA256).select(
        "prefix", F.col("n_children").alias("next_children"), F.col("n_leaves").alias("next_leaves"), F.col("saved_tokens").alias("next_saved"),
    )
    out = ["prefix", "digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_end"]
    parents = merged.select("prefix", F.col("digest").alias("parent_digest"), F.col("conv_id").alias("parent_conv_id"))
    if tier:
        earlier = ahead.where(F.col("tier") == tier).select("prefix", F.lit(EMPTY_SHA256).alias("parent_digest"), "before_id")
        parents = parents.join(earlier, ["prefix", "parent_digest"], "left").withColumn("parent_conv_id", F.coalesce("before_id", "parent_conv_id")).drop("before_id")
    done = nodes.where(~F.col("upper") & F.col("parent_digest").isNull()).select(out)
    under = nodes.where(~F.col("upper") & F.col("parent_digest").isNotNull()).drop("parent_conv_id").join(parents, ["prefix", "parent_digest"]).select(out)
    top = merged if tier == 0 else merged.where(F.col("digest") != EMPTY_SHA256)
    top = top.join(parents, ["prefix", "parent_digest"], "left").select(out)
    return scratch.cut(done.unionByName(under).unionByName(top).withColumn("tier", F.lit(tier)), "tier"), roots


def _named_prefixes(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, tier, prefix, next): names of what lies before and up to the end of each segment, from sums of hashes."""
    digest = F.sha2(F.concat_ws(":", "tier", "digest").cast("binary"), 256)
    lanes = {f"l{k}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in _LANES}
    placed = scratch.cut(_in_order(segments.select("conv_id", "tier", "digest").withColumns(lanes), "conv_id", "tier"), "lanes")
    # Sums within a slice, and of the slices before it.
    so_far = Window.partitionBy("slice", "conv_id").orderBy("tier")
    slices = placed.groupBy("conv_id", "slice").agg(*[F.sum(c).alias(c) for c in lanes])
    earlier = slices.select("conv_id", "slice", *[F.coalesce(F.sum(c).over(_before("conv_id")), F.lit(0)).alias(f"e{c}") for c in lanes])
    local = placed.withColumns({f"s{c}": F.sum(c).over(so_far) for c in lanes})

    def named(sums: list[Column]) -> Column:
        return F.concat(*[F.lpad(F.hex(s.bitwiseAND(F.lit((1 << 32) - 1))), 8, "0") for s in sums])

    upto = [F.col(f"s{c}") + F.col(f"e{c}") for c in lanes]
    before = [u - F.col(c) for u, c in zip(upto, lanes, strict=True)]
    return local.join(earlier, ["conv_id", "slice"]).select("conv_id", "tier", F.when(F.col("tier") > 0, named(before)).otherwise("").alias("prefix"), named(upto).alias("next"))


def _digests(ends: DataFrame) -> DataFrame:
    """(tier, prefix, digest, ends_sha256) of (tier, prefix, digest, conv_id): the ids in order, comma-joined, hashed.

    Ids are joined where they lie after a range partitioning; of a node with very many, one task reads the joined chunks
    one after the other, as its hash is defined over all of them in order.
    """
    key = ["tier", "prefix", "digest"]

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        columns = [batch.column(c) for c in key]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            code = column.dictionary_encode().indices.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change)))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(c[int(lo)].as_py() for c in columns), int(lo), int(hi)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, lo, hi) for k, lo, hi in runs(batch)] if batch.num_rows else []
            ids, at = batch.column("conv_id").to_pylist(), batch.column("at").to_pylist()
            yield pa.RecordBatch.from_arrays([
                *[pa.array([k[i] for k, _, _ in found], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))],
                pa.array([at[lo] for _, lo, _ in found], pa.int64()), pa.array([",".join(map(str, ids[lo:hi])) for _, lo, hi in found], pa.string()),
            ], names=[*key, "at", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def row(of: tuple, sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(key, of, strict=True)}, "ends_sha256": [sha.hexdigest()]}, schema=pa.schema(
                [("tier", pa.int32()), ("prefix", pa.string()), ("digest", pa.string()), ("ends_sha256", pa.string())]))

        for batch in batches:
            done = []
            for of, lo, hi in (runs(batch) if batch.num_rows else ()):
                for k in range(lo, hi):
                    text = batch.column("ids")[k].as_py().encode()
                    if of != current:
                        if current is not None:
                            done.append(row(current, state))
                        current, state = of, hashlib.sha256(text)
                    else:
                        state.update(b"," + text)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if current is not None:
            yield row(current, state)

    chunks = _in_order(ends, "tier", "prefix", "digest", "conv_id").mapInArrow(joined, "tier int, prefix string, digest string, at long, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "at").mapInArrow(hashed, "tier int, prefix string, digest string, ends_sha256 string")


def trie_nodes(turns: DataFrame, members: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Nodes of the prefix trie of the conversations `members` (conv_id, each once), whose turns are (conv_id, place, turn_key, words).

    A node is a distinct sequence of first turns; the root has none. Columns: conv_id (smallest member), depth, parent_conv_id
    (NULL for the root), n_convs (members, those without turns count at the root), n_children, n_leaves (nodes without
    children at or below), saved_tokens (over the nodes at or below, words of the last turn times members but one),
    ends_sha256 (of the ids that end here, ascending, comma-joined). Without members there are no nodes.
    """
    spark = turns.sparkSession
    with Scratch(spark, "trie") as scratch:
        grouped = turns.withColumn("tier", F.floor((F.col("place") - 1) / segment).cast("int")).groupBy("conv_id", "tier").agg(
            F.sort_array(F.collect_list(F.struct("place", "turn_key", "words"))).alias("t")
        )
        lengths = members.join(turns.groupBy("conv_id").agg(F.max("place").alias("length")), "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"))
        rows = grouped.select("conv_id", "tier", F.col("t.turn_key").alias("path"), F.col("t.words").alias("words")).join(lengths, "conv_id", "right").select(
            "conv_id", F.coalesce("tier", F.lit(0)).alias("tier"), F.coalesce("path", F.array().cast("array<string>")).alias("path"),
            F.coalesce("words", F.array().cast("array<long>")).alias("words"), "length",
        )
        last = F.col("length") <= (F.col("tier") + 1) * segment
        rows = scratch.cut(
            rows.withColumn("digest", F.sha2(F.array_join("path", "").cast("binary"), 256)).withColumn("n_end", last.cast("long")).drop("length"), "segments",
        )
        whole = (F.size("path") == segment) | (F.col("tier") > 0)
        named = _named_prefixes(rows.where(whole), scratch)
        full = rows.where(whole).join(named, ["conv_id", "tier"])
        rows = scratch.cut(full.unionByName(rows.where(~whole).withColumns({"prefix": F.lit(""), "next": F.lit("")})), "named")
        groups = scratch.cut(rows.where("tier > 0").groupBy("tier", "prefix").agg(F.count("*").alias("n_group")), "groups")
        shared = groups.where("n_group > 1").select("tier", "prefix")
        deepest = shared.agg(F.coalesce(F.max("tier"), F.lit(0))).first()[0]
        # Members of the nodes between two tiers, those that end there too.
        ahead = scratch.cut(
            rows.where(F.size("path") == segment).groupBy((F.col("tier") + 1).alias("tier"), F.col("next").alias("prefix")).agg(F.min("conv_id").alias("before_id")), "ahead",
        )
        parts, roots = [], None
        for tier in range(deepest, -1, -1):
            here = rows.where(F.col("tier") == tier)
            if tier:
                here = here.join(shared, ["tier", "prefix"], "left_semi")
            sequences = here.groupBy("prefix", "digest").agg(
                F.first("path").alias("path"), F.first("words").alias("words"), F.first("next").alias("next"),
                F.count("*").alias("n"), F.min("conv_id").alias("first_id"), F.sum("n_end").alias("n_end"),
            )
            if roots is None:
                roots = spark.createDataFrame([], "prefix string, next_children long, next_leaves long, next_saved long")
            # A single conversation that goes on is a chain.
            goes_on = (F.col("n") > F.col("n_end")).cast("long")
            sequences = scratch.cut(sequences.join(roots.withColumnRenamed("prefix", "next"), "next", "left").withColumns({
                "next_children": F.coalesce("next_children", goes_on), "next_leaves": F.coalesce("next_leaves", goes_on),
                "next_saved": F.coalesce("next_saved", F.lit(0).cast("long")),
            }), "sequences")
            nodes, roots = _tier_nodes(sequences, tier, ahead, segment, scratch)
            parts.append(nodes)
        nodes = parts[0]
        for more in parts[1:]:
            nodes = nodes.unionByName(more)
        # Chains: segments of one conversation alone. The node before may have other members.
        chains = rows.join(groups.where("n_group = 1").select("tier", "prefix"), ["tier", "prefix"]).join(ahead, ["tier", "prefix"])
        at_last = F.col("k") == F.size("path")
        ended = (at_last & (F.col("n_end") == 1)).cast("long")
        chains = chains.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("path")))).select(
            "prefix", F.when(at_last, F.col("digest")).alias("digest"), "conv_id", (F.col("tier") * segment + F.col("k")).cast("long").alias("depth"),
            F.when(F.col("k") == 1, F.col("before_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            (1 - ended).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ended.alias("n_end"), "tier",
        )
        nodes = nodes.unionByName(chains)
        digests = _digests(rows.where("n_end = 1").select("tier", "prefix", "digest", "conv_id"))
        ended = nodes.where("n_end > 0").join(digests, ["tier", "prefix", "digest"])
        others = nodes.where("n_end = 0").withColumn("ends_sha256", F.lit(EMPTY_SHA256))
        out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        return cut(ended.select(out).unionByName(others.select(out)), "trie")


def prefix_trie(conversations: DataFrame, graft: bool = False, segment: int = SEGMENT) -> DataFrame:
    """`trie_nodes` of a table (conv_id, turn, role, text); with `graft`, of the conversations that `grafted` makes of them.

    Other columns play no part. Order, NULLs and repeats as in `ordered_turns`.
    """
    with Scratch(conversations.sparkSession, "turns") as scratch:
        turns = ordered_turns(conversations, scratch)
        members = scratch.cut(turns.select("conv_id").distinct(), "members")
        return trie_nodes(grafted(turns, members, scratch) if graft else turns, members, segment)
