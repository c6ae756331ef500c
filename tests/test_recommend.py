from __future__ import annotations

import numpy as np
import pytest

from benchloom.operators import ratings as R, recommend
from test_ratings import SCHEMA, planted


def factors(seed, n, rank, spread):
    """Vectors whose lengths differ by a factor of about e ** spread."""
    draw = np.random.default_rng(seed)
    return draw.normal(size=(n, rank)) * np.exp(spread * draw.normal(size=(n, 1)))


def brute(users, items, k):
    return {
        (u, place): item
        for u, row in enumerate(users) for place, item in enumerate(sorted(range(len(items)), key=lambda i: (-(row @ items[i]), i))[:k], start=1)
    }


def frame(spark, key, rows):
    return spark.createDataFrame([(n, [float(x) for x in r]) for n, r in enumerate(rows)], f"{key} long, factors array<double>")


@pytest.mark.parametrize(("k", "round_blocks"), [(1, 32), (10, 2), (600, 32)])
def test_top_items_equal_brute_force(spark, monkeypatch, k, round_blocks):
    monkeypatch.setattr(recommend, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(recommend, "ROUND_BLOCKS", round_blocks)
    users, items = factors(1, 200, 6, 0.2), factors(2, 500, 6, 1.0)
    got = recommend.top_items(frame(spark, "user", users), frame(spark, "item", items), k).collect()
    assert {(r.user, r.place): r.item for r in got} == brute(users, items, k)
    assert all(abs(r.score - users[r.user] @ items[r.item]) < 1e-9 for r in got)


def test_blocks_of_short_items_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK_ITEMS", 25)
    users, items = factors(3, 200, 4, 0.0), factors(4, 500, 4, 1.5)
    rounds = []
    got = recommend.top_items(frame(spark, "user", users), frame(spark, "item", items), 5, rounds)
    assert {(r.user, r.place): r.item for r in got.collect()} == brute(users, items, 5)
    read = [r.n_blocks for r in got.select("user", "n_blocks").distinct().collect()]
    assert len(read) == 200 and sum(read) < 0.3 * 20 * 200 and max(read) < 20
    assert rounds == sorted(rounds, reverse=True) and len(rounds) <= 5


def test_ties_nulls_and_empty_tables(spark):
    items = spark.createDataFrame(
        [(9, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [1.0, 0.0]), (1, None), (None, [9.0, 9.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (7, [0.0, 0.0])],
        "item long, factors array<double>",
    )
    users = spark.createDataFrame([(1, [1.0, 5.0]), (2, [0.0, 0.0]), (3, None)], "user long, factors array<double>")
    got = [(r.user, r.place, r.item) for r in recommend.top_items(users, items, 3).orderBy("user", "place").collect()]
    assert got == [(1, 1, 2), (1, 2, 5), (1, 3, 9), (2, 1, 2), (2, 2, 5), (2, 3, 7)]
    assert recommend.top_items(users.limit(0), items, 3).count() == 0 and recommend.top_items(users, items.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        recommend.top_items(users, items, 0)


def test_als_recommends_what_it_scores_highest(spark):
    rows = spark.createDataFrame([(u + 10**12, i, r) for u, i, r in planted(20, 15)], SCHEMA)
    model = R.fit_als(rows, rank=4, iters=5)
    users = rows.select("user").distinct()
    scored = model.score(users.join(rows.select("item").distinct())).collect()
    best = {}
    for r in sorted(scored, key=lambda r: -r.prediction):
        best.setdefault(r.user, []).append(r)
    got = model.recommend(users.where(f"user < {10**12 + 9}"), 3).collect()
    assert len(got) == 27
    for r in got:
        want = best[r.user][r.place - 1]
        assert r.item == want.item and abs(r.score - want.prediction) < 1e-5
    # A liked item is of the user's own parity.
    assert all(r.user % 2 == r.item % 2 for r in got)


def test_ratings_with_null_ids_have_no_part(spark):
    rows = planted(12, 8)
    odd = spark.createDataFrame([*rows, (None, 1, 900.0), (1, None, 900.0), (1, 1, None)], SCHEMA)
    plain = R.bias_baseline(spark.createDataFrame(rows, SCHEMA))
    got = R.bias_baseline(odd)
    assert got.count() == len(rows)
    want = {(r.user, r.item): r.baseline for r in plain.collect()}
    assert all(abs(want[r.user, r.item] - r.baseline) < 1e-9 for r in got.collect())
    assert R.fit_als(odd, rank=2, iters=2).score(odd.dropna()).count() == len(rows)
