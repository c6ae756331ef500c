from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.operators import ratings as R, skew
from benchloom.storage import work_dir
from conftest import plan_of

SCHEMA = "user long, item long, rating double"


def hot_ratings(seed=0):
    """User 1 rates every item and item 1 is rated by every user."""
    rng = random.Random(seed)
    pairs = {(1, i) for i in range(1, 25)} | {(u, 1) for u in range(1, 25)}
    pairs |= {(rng.randrange(1, 25), rng.randrange(1, 25)) for _ in range(40)}
    return [(u, i, float(rng.randrange(1, 6))) for u, i in sorted(pairs)]


def planted(users=60, items=40, seed=0):
    """Ratings of two tastes: users like items of their own parity."""
    rng = random.Random(seed)
    return [
        (u, i, (4.5 if u % 2 == i % 2 else 1.5) + rng.uniform(-0.3, 0.3))
        for u in range(users) for i in range(items) if rng.random() < 0.6
    ]


def test_bias_baseline(spark, lookup_size, no_auto_broadcast):
    rows = hot_ratings()
    mean = np.mean([r for _, _, r in rows])
    by_user = {u: np.mean([r for v, _, r in rows if v == u]) for u, _, _ in rows}
    by_item = {i: np.mean([r for _, j, r in rows if j == i]) for _, i, _ in rows}
    got = R.bias_baseline(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(abs(r.baseline - (by_user[r.user] + by_item[r.item] - mean)) < 1e-9 for r in got)


def draw(seed, letter, key):
    digest = hashlib.md5(f"{seed}:{letter}:{key}".encode()).hexdigest()
    return R.START * ((int(digest[:13], 16) + 0.5) / 2**52 - 0.5)


def numpy_svdpp(rows, rank, iters, rate, reg_bias, reg_factor, bounds, seed):
    users, items = sorted({u for u, _, _ in rows}), sorted({i for _, i, _ in rows})
    at_u, at_i = {u: n for n, u in enumerate(users)}, {i: n for n, i in enumerate(items)}
    u = np.array([at_u[a] for a, _, _ in rows])
    i = np.array([at_i[b] for _, b, _ in rows])
    r = np.array([c for _, _, c in rows])
    n_u, n_i = np.bincount(u), np.bincount(i)
    mean = r.mean()
    b_u, b_i = np.bincount(u, r) / n_u - mean, np.bincount(i, r) / n_i - mean
    p, q, y = (
        np.array([[draw(seed, f"{c}{k}", key) for k in range(rank)] for key in keys])
        for c, keys in (("p", users), ("q", items), ("y", items))
    )

    def full():
        z = np.zeros_like(p)
        np.add.at(z, u, y[i])
        return p + z / np.sqrt(n_u)[:, None]

    def estimate(pz):
        return np.clip(mean + b_u[u] + b_i[i] + (q[i] * pz[u]).sum(1), *bounds)

    for _ in range(iters):
        pz = full()
        err = r - estimate(pz)
        gp, gq, gy = np.zeros_like(p), np.zeros_like(q), np.zeros_like(y)
        np.add.at(gp, u, err[:, None] * q[i])
        np.add.at(gq, i, err[:, None] * pz[u])
        np.add.at(gy, i, (err / np.sqrt(n_u[u]))[:, None] * q[i])
        b_u = b_u + rate * (np.bincount(u, err) / n_u - reg_bias * b_u)
        b_i = b_i + rate * (np.bincount(i, err) / n_i - reg_bias * b_i)
        p = p + rate * (gp / n_u[:, None] - reg_factor * p)
        q = q + rate * (gq / n_i[:, None] - reg_factor * q)
        y = y + rate * (gy / n_i[:, None] - reg_factor * y)
    return estimate(full())


def test_svdpp_equals_numpy_with_hot_user_and_item(spark, lookup_size, no_auto_broadcast):
    rows = hot_ratings()
    model = R.svdpp(spark.createDataFrame(rows, SCHEMA), rank=3, iters=2, rate=0.3, bounds=(0.0, 5.0), seed=5)
    got = {(r.user, r.item): r.prediction for r in model.predict(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = numpy_svdpp(rows, 3, 2, 0.3, 0.005, 0.015, (0.0, 5.0), 5)
    assert len(got) == len(rows)
    assert all(abs(got[u, i] - w) < 1e-9 for (u, i, _), w in zip(rows, want))


def test_svdpp_learns_tastes_that_biases_cannot():
    """On the numpy form, which the test above ties to the Spark one."""
    rows = planted()
    r = np.array([c for _, _, c in rows])
    start, end = (np.sqrt(np.mean((r - numpy_svdpp(rows, 4, n, 0.5, 0.005, 0.015, (0.0, 5.0), 1)) ** 2))
                  for n in (0, 20))
    assert end < 0.2 * start


@pytest.mark.parametrize("shift", [0, 2**40])
def test_als_beats_the_bias_baseline(spark, shift):
    rows = [(u + shift, i, r) for u, i, r in planted()]
    frame = spark.createDataFrame(rows, SCHEMA)
    scored = R.fit_als(frame, rank=4, iters=5).score(frame)
    row = R.rmse(scored).first()
    base = R.rmse(R.bias_baseline(frame), "baseline").first()
    assert row.n == len(rows) and row.rmse < 0.5 * base.rmse
    assert set(scored.columns) == {"user", "item", "rating", "prediction"}


def test_dense_ids_have_no_gaps(spark):
    frame = spark.range(1000).repartition(7).selectExpr("id * 5000000000 AS user", "1L AS item", "1.0D AS rating")
    row = R._dense_ids(frame, "user").agg(
        F.min("user_number"), F.max("user_number"), F.count_distinct("user_number"), F.count_distinct("user")).first()
    assert tuple(row) == (0, 999, 1000, 1000)


def test_als_of_no_ratings_is_a_clear_error(spark):
    with pytest.raises(ValueError, match="ratings"):
        R.fit_als(spark.createDataFrame([], "user long, item long, rating double"))


def test_svdpp_leaves_no_tables_of_its_steps(spark):
    rows = spark.createDataFrame(hot_ratings(), SCHEMA)
    folder = f"{work_dir(spark)}/benchloom".removeprefix("file:")
    held = lambda: {n for n in os.listdir(folder) if os.listdir(f"{folder}/{n}")} if os.path.isdir(folder) else set()
    before = held()
    left = {}
    for iters in (1, 4):
        R.svdpp(rows, rank=2, iters=iters).predict(rows).count()
        left[iters] = len(held() - before)
        before = held()
    assert left[1] == left[4]


def test_als_blocks_grow_with_the_ratings_and_no_faster_than_tasks_need(spark):
    assert R.als_blocks(3_600_000) == R.als_blocks(36_000_000) == 10
    assert 10 < R.als_blocks(216_000_000) < 20 and R.als_blocks(2_160_000_000) > 100


def test_als_scores_pairs_as_the_model_does_in_two_joins(spark, no_auto_broadcast, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    frame = spark.createDataFrame([*planted(), (1, 1, None), (10**9, 1, 2.0)], SCHEMA)
    fitted = R.fit_als(frame.where("user < 1000"), rank=4, iters=3)
    scored = fitted.score(frame)
    want = fitted.model.transform(fitted.numbered(frame)).select(scored.columns)
    assert scored.exceptAll(want).isEmpty() and want.exceptAll(scored).isEmpty() and scored.count() > 100
    assert plan_of(scored).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 4


def test_svdpp_shuffles_sums_of_cells_and_not_ratings(spark, no_auto_broadcast, monkeypatch):
    """Several cells give what one gives, a step groups the cells, and their side grows with the root of the ratings."""
    rows = [*hot_ratings(3), *[(u, i, None if i == 3 else float(u % 5)) for u in range(100, 140) for i in range(1, 25)], (None, 3, 1.0), (5, None, 1.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for cell in (10**6, 200):
        monkeypatch.setattr(R, "RATINGS_PER_CELL", cell)
        monkeypatch.setattr(R, "RATINGS_AT_ONCE", cell)
        model = R.svdpp(frame, rank=2, iters=2, rate=0.3, bounds=(0.0, 5.0))
        got[cell] = {(r.user, r.item): r.prediction for r in model.predict(frame).collect()}
        assert len(got[cell]) == len({(u, i) for u, i, _ in rows if u and i})
    assert R.cell_side(len(rows)) > 2 and all(abs(x - got[200][k]) < 1e-9 for k, x in got[10**6].items())
    counted, plain = [], R.Scratch.cut
    monkeypatch.setattr(R.Scratch, "cut", lambda self, df, name: counted.append((name, plan_of(df))) or plain(self, df, name))
    R.svdpp(frame, rank=2, iters=1, rate=0.3, bounds=(0.0, 5.0))
    plan = dict(counted)["steps"].split("== Physical Plan ==")[1].split("InMemoryRelation")[0]
    assert "FlatMapCoGroupsInArrow" in plan
    monkeypatch.undo()
    assert [R.cell_side(n) for n in (0, 600_000, 3_600_000, 36_000_000, 216_000_000)] == [1, 2, 3, 3, 8]


def test_als_blocks_fit_the_heap_of_a_task(spark):
    """At 216 million ratings and 900 MB a task a block has no more ratings than one of 10 at 36 million, and few ratings have 10."""
    assert 50 <= R.als_blocks(216_000_000, 900 << 20) <= 70
    assert R.als_blocks(600_000, 900 << 20) == R.als_blocks(36_000_000, 2 << 30) == 10
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    assert R.task_heap(spark) == heap // 8


def test_als_makes_its_blocks_by_the_heap_and_keeps_stored_factors_alone(spark, monkeypatch):
    frame, asked, plain = spark.createDataFrame(planted(), SCHEMA), [], R.als_blocks
    monkeypatch.setattr(R, "als_blocks", lambda *args: asked.append(args) or plain(*args))
    fitted = R.fit_als(frame, rank=2, iters=2)
    assert asked == [(frame.count(), R.task_heap(spark))]
    for factors in (fitted.model.userFactors, fitted.model.itemFactors):
        assert "FileScan parquet" in plan_of(factors) and "ExistingRDD" not in plan_of(factors)
    folder = f"{work_dir(spark)}/benchloom".removeprefix("file:")
    assert not [n for n in os.listdir(folder) if n.startswith("als-") and not n.startswith("als-model-")]
