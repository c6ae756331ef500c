"""Rating workloads over (user, item, rating): bias baseline, ALS factors, SVD++."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from benchloom.functions.columns import uniform
from benchloom.operators.recommend import top_items
from benchloom.operators.skew import lookup_join
from benchloom.storage import Scratch, cut, new_path, work_dir


def _mean_by(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.avg("rating").alias(f"{key}_mean"), F.count("*").alias("n"))


def bias_baseline(ratings: DataFrame) -> DataFrame:
    """Each rating with mu + b_u + b_i, where a bias is the mean of its user or item less mu.

    A rating with a NULL id or value has no part in any mean and is left out.
    """
    ratings = ratings.dropna(subset=["user", "item", "rating"])
    mu = ratings.agg(F.avg("rating")).scalar()
    rows = ratings
    for key, other in (("user", "item"), ("item", "user")):
        rows = lookup_join(rows, cut(_mean_by(ratings, key), f"{key}-means"), key, [other])
    return rows.select(
        "user", "item", "rating", (F.col("user_mean") + F.col("item_mean") - mu).alias("baseline")
    )


# Width of the range around 0 from which SVD++ start factors are drawn.
START = 0.5

# Ratings that one cell of SVD++ holds in the mean, and how many of them are worked on at a time. A user's state goes to as many
# cells as the square root of their number, so more cells than needed multiply what is shuffled; a few are made of fewer
# ratings too, for more than one task.
RATINGS_PER_CELL, RATINGS_AT_ONCE = 4_000_000, 500_000
FEW_CELLS = 3

# Ratings that one block of ALS holds, so that its tasks grow in number with the data and not in size. In each step a user's
# factors go to every block that holds an item the user rated, so more blocks than needed multiply what is shuffled.
RATINGS_PER_BLOCK = 16_000_000

# Bytes that a rating takes in the task that builds its block, with the factors it meets there, and the share of a task's heap for them.
BLOCK_BYTES_PER_RATING, BLOCK_SHARE = 100, 0.4


def _dense_ids(ratings: DataFrame, key: str) -> DataFrame:
    """Every id of a column with its count and a number, 0 and up without gaps.

    Rows are numbered inside their partition, and partitions are offset by the rows before
    them; no sort and no single task over all ids.
    """
    position = F.monotonically_increasing_id()  # partition number in the upper 31 bits
    # Sorted, so that the numbers do not depend on the order in which rows arrive.
    placed = cut(
        ratings.groupBy(key).agg(F.count("*").alias("n")).sortWithinPartitions(key).withColumn("place", position), f"{key}-ids"
    )
    part = F.shiftright("place", 33)
    # One row per partition.
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    known = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    return cut(
        placed.withColumn("part", part).join(F.broadcast(known), "part")
        .select(key, "n", number.cast("int").alias(f"{key}_number")),
        f"{key}-numbers",
    )


class Als:
    """Fitted ALS model, with the numbers that its users and items have in it."""

    def __init__(self, users: DataFrame, items: DataFrame, model: ALSModel | None = None):
        self.users, self.items, self.model = users, items, model

    def numbered(self, pairs: DataFrame) -> DataFrame:
        pairs = lookup_join(pairs, self.users, "user", ["item"])
        return lookup_join(pairs, self.items, "item", ["user"])

    def score(self, pairs: DataFrame) -> DataFrame:
        """Estimated rating of each (user, item) pair the model knows both ends of.

        Factors are joined to the ids they belong to first, which are few beside the pairs; these are then shuffled twice, not
        once for each number and once for each factor.
        """
        for side, factors, key, other in ((self.users, self.model.userFactors, "user", "item"), (self.items, self.model.itemFactors, "item", "user")):
            known = side.join(factors, F.col(f"{key}_number") == F.col("id")).select(key, "n", F.col("features").alias(f"{key}_factors"))
            pairs = lookup_join(pairs, cut(known, f"{key}-factors"), key, [other])
        # Single precision, in the order of the factors, as the model itself adds up.
        products = F.zip_with("user_factors", "item_factors", lambda a, b: a * b)
        dot = F.aggregate(products, F.lit(0.0).cast("float"), lambda total, x: total + x)
        return pairs.withColumn("prediction", dot).drop("user_factors", "item_factors").dropna(subset=["prediction"])

    def recommend(self, users: DataFrame, k: int) -> DataFrame:
        """The k items of highest estimate for each of the `users` that the model knows: (user, place, item, score, n_blocks)."""
        asked = self.users.join(users.select("user").distinct(), "user", "left_semi")
        rows = asked.join(self.model.userFactors, F.col("user_number") == F.col("id")).select("user", F.col("features").alias("factors"))
        items = self.items.join(self.model.itemFactors, F.col("item_number") == F.col("id")).select("item", F.col("features").alias("factors"))
        return top_items(rows, items, k)


def task_heap(spark: SparkSession) -> int:
    """Bytes of heap of an executor for each task that it runs at a time."""
    context = spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return context._jvm.java.lang.Runtime.getRuntime().maxMemory() // context.defaultParallelism
    scala = context._jsc.sc()
    # The driver is one of those that report their memory.
    executors = max(1, scala.getExecutorMemoryStatus().size() - 1)
    cores = int(context.getConf().get("spark.executor.cores", "0")) or math.ceil(context.defaultParallelism / executors)
    return (scala.executorMemory() << 20) // cores


def als_blocks(n_ratings: int, heap: int | None = None) -> int:
    """Blocks of users, and of items, that ALS makes of so many ratings; 10 are the least, as Spark ML has by itself.

    With a `heap` for each task, none gets a block that does not fit it.
    """
    blocks = max(10, math.ceil(n_ratings / RATINGS_PER_BLOCK))
    return blocks if heap is None else max(blocks, math.ceil(n_ratings * BLOCK_BYTES_PER_RATING / (heap * BLOCK_SHARE)))


def fit_als(ratings: DataFrame, rank: int = 10, iters: int = 10, reg: float = 0.1, seed: int = 42) -> Als:
    """Matrix factorization by alternating least squares. ALS takes 32-bit ids, so users and items are numbered.

    Ratings with a NULL id or value are left out; without any others there is an error.
    """
    spark = ratings.sparkSession
    work_dir(spark)  # ALS cuts its lineage in the checkpoint folder
    ratings = ratings.dropna(subset=["user", "item", "rating"])
    n_ratings = ratings.count()
    if not n_ratings:
        raise ValueError("ratings without users and items cannot be fitted")
    blocks = als_blocks(n_ratings, task_heap(spark))
    fitted = Als(_dense_ids(ratings, "user"), _dense_ids(ratings, "item"))
    als = ALS(
        userCol="user_number", itemCol="item_number", ratingCol="rating", rank=rank, maxIter=iters,
        regParam=reg, seed=seed, coldStartStrategy="drop", numUserBlocks=blocks, numItemBlocks=blocks,
        # At each checkpoint ALS removes what it shuffled since the one before.
        checkpointInterval=1,
    )
    path = new_path(spark, "als-model")
    with Scratch(spark, "als") as scratch:
        numbered = scratch.cut(fitted.numbered(ratings).withColumn("rating", F.col("rating").cast("float")), "numbered")
        als.fit(numbered.select("user_number", "item_number", "rating")).save(path)
    # Stored factors need none of what they were made from: blocks and shuffles go with the garbage of the driver.
    fitted.model = ALSModel.load(path)
    spark.sparkContext._jvm.System.gc()
    return fitted


def rmse(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    error = F.col("rating") - F.col(prediction)
    return scored.agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"))


def _dot(left: str, right: str, rank: int) -> Column:
    return sum((F.col(f"{left}{k}") * F.col(f"{right}{k}") for k in range(rank)), F.lit(0.0))


class SvdPlusPlus:
    """Fitted SVD++ state: mean rating, users (b_u, p, implicit sum) and items (b_i, q, y)."""

    def __init__(self, mean: float, users: DataFrame, items: DataFrame, rank: int, bounds: tuple[float, float]):
        self.mean, self.users, self.items, self.rank, self.bounds = mean, users, items, rank, bounds

    def estimate(self) -> Column:
        """mu + b_u + b_i + q . (p + |N(u)|^-1/2 * sum of y over N(u)), held within the bounds."""
        raw = self.mean + F.col("b_u") + F.col("b_i") + _dot("q", "pz", self.rank)
        return F.greatest(F.lit(self.bounds[0]), F.least(F.lit(self.bounds[1]), raw))

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Estimate for (user, item) pairs the model knows both ends of."""
        for side, key, other in ((self.users, "user", "item"), (self.items, "item", "user")):
            pairs = lookup_join(pairs, side, key, [other])
        names = ["user", "item", *(["rating"] if "rating" in pairs.columns else [])]
        return pairs.select(*names, self.estimate().alias("prediction"))

    def recommend(self, users: DataFrame, k: int) -> DataFrame:
        """The k items of highest estimate, not held within bounds, for each of the `users` that the model knows."""
        asked = self.users.join(users.select("user").distinct(), "user", "left_semi")
        factors = F.array(*_columns("pz", self.rank), F.lit(1.0))
        rows = asked.select("user", factors.alias("factors"))
        items = self.items.select("item", F.array(*_columns("q", self.rank), F.col("b_i")).alias("factors"))
        best = top_items(rows, items, k)
        with_bias = best.join(asked.select("user", "b_u"), "user")
        return with_bias.withColumn("score", F.col("score") + F.col("b_u") + self.mean).select(best.columns)


def _columns(letter: str, rank: int) -> list[str]:
    return [f"{letter}{k}" for k in range(rank)]


def cell_side(n_ratings: int) -> int:
    """Groups of users, and of items, that SVD++ makes for so many ratings."""
    few = min(FEW_CELLS, math.ceil(math.sqrt(n_ratings / RATINGS_AT_ONCE)))
    return max(1, few, math.ceil(math.sqrt(n_ratings / RATINGS_PER_CELL)))


def svdpp(
    ratings: DataFrame, rank: int = 10, iters: int = 10, rate: float = 0.5,
    reg_bias: float = 0.005, reg_factor: float = 0.015,
    bounds: tuple[float, float] | None = None, seed: int = 42,
) -> SvdPlusPlus:
    """SVD++ (Koren, KDD 2008) by full-batch gradient steps; (user, item) pairs must be unique.

    A step moves each user and item by the mean gradient over its ratings, so that one with
    very many ratings takes no larger step than others; `rate` suits ratings up to about 5, and
    larger ones need a smaller rate. Estimates are held within `bounds`, those of the ratings if
    none are given. Start factors are drawn from ids and seed.

    Ratings lie in a square of cells, one row of cells for each group of users and one column for each group of items, and
    stay cached there: they are shuffled once, whatever the number of steps. A step sends users along their row and items
    along their column, and each cell sends back one sum for every user and item in it. So a hot user or item is spread over a row or
    column of cells, and what is shuffled grows with users and items times the side of the square.
    """
    users, items = (
        cut(_mean_by(ratings, key).withColumnRenamed(f"{key}_mean", "mean"), f"{key}-means")
        for key in ("user", "item")
    )
    total, n_ratings = users.agg(F.sum(F.col("mean") * F.col("n")), F.sum("n")).first()
    mean = total / n_ratings if n_ratings else 0.0
    if bounds is None:
        low, high = ratings.agg(F.min("rating").cast("double"), F.max("rating").cast("double")).first()
        bounds = (low or 0.0, high or 0.0)
    side = cell_side(n_ratings or 0)
    every = F.sequence(F.lit(0), F.lit(side - 1))
    places = {key: F.pmod(F.xxhash64(key), F.lit(side)).cast("int") for key in ("user", "item")}
    rows = (
        ratings.select("user", "item", F.col("rating").cast("double").alias("rating"), (places["user"] * side + places["item"]).alias("cell"))
        .repartition(side * side, "cell").sortWithinPartitions("cell").persist()
    )
    types = {key: ratings.schema[key].dataType.simpleString() for key in ("user", "item")}

    def in_cells(state: DataFrame, key: str, columns: list[Column | str]) -> DataFrame:
        """A state in every cell of its row or column."""
        other = F.explode(every).alias("other")
        cell = places["user"] * side + F.col("other") if key == "user" else F.col("other") * side + places["item"]
        return state.select("*", other).select(cell.alias("cell"), key, *columns)

    def draws(key: str, letter: str) -> list[Column]:
        return [(START * (uniform(seed, F.lit(c), F.col(key)) - 0.5)).alias(c) for c in _columns(letter, rank)]

    p, q, y, z, pz = (_columns(c, rank) for c in ("p", "q", "y", "z", "pz"))
    user_state = users.select("user", "n", (F.col("mean") - mean).alias("b_u"), *draws("user", "p"))
    item_state = cut(
        items.select("item", "n", (F.col("mean") - mean).alias("b_i"), *draws("item", "q"), *draws("item", "y")),
        "svdpp-items",
    )

    def met(own: pa.Table, users: pa.Table | None, items: pa.Table) -> tuple[pa.Table, np.ndarray | None, np.ndarray]:
        """The ratings of a cell whose user and item are known, and the places of both."""
        at = [pc.index_in(own[k], value_set=t[k].combine_chunks(), skip_nulls=True) if t else None for k, t in (("user", users), ("item", items))]
        known = pc.and_(pc.is_valid(at[0] if users else own["user"]), pc.is_valid(at[1]))
        return own.filter(known), *(x.filter(known).to_numpy().astype(np.int64) if x else None for x in at)

    def implicit(own: pa.Table, items: pa.Table) -> pa.Table:
        own, _, i = met(own, None, items)
        ids = own["user"].combine_chunks().dictionary_encode()
        u, n = ids.indices.to_numpy(), len(ids.dictionary)
        sums = [np.bincount(u, items[a].fill_null(0.0).to_numpy()[i], minlength=n) for a in y]
        return pa.table([ids.dictionary, *map(pa.array, sums)], names=["user", *z])

    implicit_shape = ", ".join([f"user {types['user']}", *[f"{c} double" for c in z]])

    def with_implicit(user_state: DataFrame, item_state: DataFrame) -> DataFrame:
        """Users with pz = p + |N(u)|^-1/2 * sum of y over the items they rated."""
        shares = in_cells(item_state, "item", y)
        sums = rows.groupBy("cell").cogroup(shares.groupBy("cell")).applyInArrow(implicit, implicit_shape)
        sums = sums.groupBy("user").agg(*[F.sum(c).alias(c) for c in z])
        return user_state.join(sums, "user").select(
            "user", "n", "b_u", *p,
            *[(F.col(a) + F.col(b) / F.sqrt("n")).alias(c) for a, b, c in zip(p, z, pz)],
        )

    g, h, f = (_columns(c, rank) for c in ("g", "h", "f"))
    low, high = map(float, bounds)
    at_once = RATINGS_AT_ONCE

    def gradients(own: pa.Table, states: pa.Table) -> pa.Table:
        """Of each user and item in a cell: the ratings that have a value, and the sums of their gradients."""
        users, items = states.filter(pc.is_valid(states["user"])), states.filter(pc.is_valid(states["item"]))
        own, u, i = met(own, users, items)
        here = [np.unique(u), np.unique(i)]
        valued = pc.is_valid(own["rating"])
        rated = valued.to_numpy()
        u, i, rating = u[rated], i[rated], own["rating"].filter(valued).to_numpy()
        b_u, n_u, pzs = users["b"].to_numpy(), users["n"].to_numpy(), [users[c].to_numpy() for c in f]
        b_i, qs = items["b"].to_numpy(), [items[c].to_numpy() for c in f]
        to_user, to_item = np.zeros((1 + rank, users.num_rows)), np.zeros((1 + 2 * rank, items.num_rows))
        for lo in range(0, len(u), at_once):
            at_u, at_i = u[lo:lo + at_once], i[lo:lo + at_once]
            dot = sum((a[at_i] * b[at_u] for a, b in zip(qs, pzs)), np.zeros(len(at_u)))
            # A NULL has become a NaN; the bounds are what is left then, as in `estimate`.
            err = rating[lo:lo + at_once] - np.maximum(low, np.fmin(high, mean + b_u[at_u] + b_i[at_i] + dot))
            share = err / np.sqrt(n_u[at_u])
            for k, x in enumerate([err, *[err * a[at_i] for a in qs]]):
                to_user[k] += np.bincount(at_u, x, minlength=users.num_rows)
            for k, x in enumerate([err, *[err * b[at_u] for b in pzs], *[share * a[at_i] for a in qs]]):
                to_item[k] += np.bincount(at_i, x, minlength=items.num_rows)
        parts = []
        for at, ids, key, sent in ((u, here[0], "user", to_user), (i, here[1], "item", to_item)):
            known = users if key == "user" else items
            sums = [x[ids] for x in sent]
            nothing = np.zeros(len(ids))
            parts.append(pa.table(
                [known["user"].take(pa.array(ids)), known["item"].take(pa.array(ids)), pa.array(np.bincount(at, minlength=known.num_rows)[ids]),
                 *[pa.array(x) for x in (*sums, *[nothing] * (1 + 2 * rank - len(sums)))]],
                names=["user", "item", "c", *names],
            ))
        return pa.concat_tables(parts)

    names = ["g", *g, *h]
    gradient_shape = ", ".join([*[f"{key} {t}" for key, t in types.items()], "c long", *[f"{c} double" for c in names]])

    before = None
    for _ in range(iters):
        # Tables of a step are read by the next one and then removed.
        now = Scratch(ratings.sparkSession, "svdpp")
        full = now.cut(with_implicit(user_state, item_state), "users")
        absent = {key: F.lit(None).cast(t).alias(key) for key, t in types.items()}
        states = in_cells(full, "user", [absent["item"], "n", F.col("b_u").alias("b"), *[F.col(a).alias(b) for a, b in zip(pz, f)]]).unionByName(
            in_cells(item_state, "item", [absent["user"], "n", F.col("b_i").alias("b"), *[F.col(a).alias(b) for a, b in zip(q, f)]]))
        sent = rows.groupBy("cell").cogroup(states.groupBy("cell")).applyInArrow(gradients, gradient_shape)
        n_valued = F.nullif(F.sum("c"), F.lit(0))
        steps = now.cut(sent.groupBy("user", "item").agg(*[(F.sum(c) / n_valued).alias(c) for c in names]), "steps")

        def moved(old: str, gradient: str, reg: float) -> Column:
            return (F.col(old) + rate * (F.col(gradient) - reg * F.col(old))).alias(old)

        user_state = full.join(
            steps.where("user IS NOT NULL").drop("item"), "user"
        ).select(
            "user", "n", moved("b_u", "g", reg_bias), *[moved(c, f"g{k}", reg_factor) for k, c in enumerate(p)]
        )
        item_state = now.cut(
            item_state.join(steps.where("item IS NOT NULL").drop("user"), "item").select(
                "item", "n", moved("b_i", "g", reg_bias),
                *[moved(c, f"g{k}", reg_factor) for k, c in enumerate(q)],
                *[moved(c, f"h{k}", reg_factor) for k, c in enumerate(y)],
            ),
            "items",
        )
        if before:
            before.close()
        before = now
    users_out, items_out = cut(with_implicit(user_state, item_state), "svdpp-users"), cut(item_state, "svdpp-items")
    if before:
        before.close()
    rows.unpersist()
    return SvdPlusPlus(mean, users_out, items_out, rank, bounds)
