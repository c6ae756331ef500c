"""Prefix trie against brute force, in one shard and in many, with segments of one turn and of many."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from benchloom.llm import trie
from benchloom.llm.workers import importable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


def brute(rows, graft=False):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, name, role, text))
    told = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    if graft:
        whole = {}
        for c, own in told.items():
            h = zlib.crc32(str(c).encode()) % 4
            whole[c] = told.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[h:]
        told = whole
    nodes = defaultdict(lambda: (set(), set(), set()))
    for c, own in told.items():
        for d in range(len(own) + 1):
            members, children, ends = nodes[tuple(own[:d])]
            members.add(c)
            if d < len(own):
                children.add(own[d])
            else:
                ends.add(c)
    below, out = {}, []
    for path in sorted(nodes, key=len, reverse=True):
        members, children, ends = nodes[path]
        parts = [below[path + (c,)] for c in children]
        words = len(WORD.findall(path[-1][1])) if path else 0
        below[path] = (sum(p[0] for p in parts) or 1, sum(p[1] for p in parts) + (len(members) - 1) * words)
        out.append((
            min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members), len(children), *below[path],
            hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def conversations(seed=1, n=90):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(n), -5, -20, -41]:
        start = draw.choice([[], ["sys"], ["sys", "hi there"], ["sys", "hi there", "what  is\tup"]])
        texts = start + [draw.choice(["a b", "c", "", None, "d e f"]) for _ in range(draw.randint(0 if start else 1, 7))]
        rows += [(conv, k, draw.choice(["user", "user", "user", None]) if k > 2 else "user", t) for k, t in enumerate(texts)]
    copy = [("user", "same"), ("bot", "old"), ("user", "story " * 3)] * 3
    # Copies, one that goes on, one far longer than the others and its copy, a base that is not there.
    rows += [(c, k, r, t) for c in range(200, 240) for k, (r, t) in enumerate(copy)] + [(200, 50, "user", "more")]
    rows += [(c, k, "user", f"t{k % 5}") for c in (300, 320) for k in range(22)] + [(320, 22, "user", "on")]
    rows += [(413, 0, "user", "no base"), (417, 0, "user", "x"), (417, 1, "user", "y")]
    # NULL and repeated turns, a row without a conversation.
    return rows + [(7, None, "bot", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "lost")]


@pytest.mark.parametrize(("segment", "shard"), [(128, 20_000), (128, 6), (4, 9), (2, 5)])
def test_nodes_against_brute_force(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(trie, "SHARD_SEQUENCES", shard)
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(trie.prefix_trie(table, graft=True, segment=segment)) == brute(rows, graft=True)


def test_without_grafts(spark):
    rows = conversations(2, 40)
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), segment=16)) == brute(rows)


def test_one_conversation_with_most_rows_needs_no_large_trie(spark, monkeypatch):
    rows = [(1, k, "user", f"t{k % 3}") for k in range(3000)] + [(2, 0, "user", "t0"), (21, 0, "bot", "z")]
    shard_nodes = trie._shard_nodes

    def counting(table, above):
        nodes = shard_nodes(table, above)
        assert nodes.num_rows <= 3 * 64
        return nodes

    monkeypatch.setattr(trie, "_shard_nodes", counting)
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), graft=True, segment=64)) == brute(rows, graft=True)


def test_empty_tables_and_other_columns(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA), graft=True).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "x"), (2, 0, "user", "x")]
    odd = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA + ", prefix string, words int")
    assert got(trie.prefix_trie(odd)) == brute(rows)


def test_base_and_check_arrays(spark):
    """Every pair of a state and a code leads to its own child, and no other code leads anywhere."""
    draw = random.Random(4)
    paths = [[draw.randint(1, 40) for _ in range(draw.randint(1, 6))] for _ in range(400)] + [[k] for k in range(1, 41)]
    lengths = np.array([len(p) for p in paths])
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    codes = np.concatenate([np.array(p) for p in paths])
    built = trie._packed(np.zeros(len(paths), dtype=np.int64), codes, first, lengths)
    named = {(): 0}
    for path in paths:
        for d in range(len(path)):
            child = int(built.step(np.array([named[tuple(path[:d])]]), np.array([path[d]]))[0])
            assert child > 0 and named.setdefault(tuple(path[:d + 1]), child) == child
    assert len(set(named.values())) == len(named)
    for path, state in named.items():
        children = {c for c in range(1, 41) if built.step(np.array([state]), np.array([c]))[0] >= 0}
        assert children == {p[-1] for p in named if p and p[:-1] == path}
