"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times the mix takes it. Among all rates up to
`most` whose tokens meet each source's target, entropy balancing picks those nearest to 1 in
relative entropy. The dual of that problem is convex with one multiplier per source, and its
optimum tilts the rates exponentially in the document's size: rate = min(most, exp(m * size / scale)).
Newton's method solves all duals at once, one aggregation a step. As a rate depends on source and
size alone, the steps run on the histogram of both, never on the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from benchloom.llm.frames import fresh
from benchloom.storage import cut

# Documents of one source and size that are ranked together when copies are dealt out.
CELL_ROWS = 50_000
# A source is solved when its tokens are this near to the target, as a share of it.
CLOSE = 1e-4
MOST_STEPS = 60


def n_tokens(text: str) -> Column:
    """Number of runs of other characters than space and \\t \\n \\v \\f \\r; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _exact(x: Column) -> Column:
    """A term of a sum that must not depend on the order of adding, so that reruns agree."""
    return x.cast("decimal(38,9)")


def source_targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets of sources (source, source_size): shares of the total by weight, none over most * source_size.

    Sources weigh `weights` in turn, in order of code points, NULL last. What a source cannot
    take goes to the others by weight, until none is above its bound: with sources in order of
    bound / weight, those before the first that stays below the common level are at their bound.
    One row per source goes through one task here, as ranks over all sources need.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    weighed = sizes.select(
        "source", "source_size", (F.col("source_size") * most).alias("bound"),
        F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
        .cast("long").alias("weight"),
    )
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("bound").over(earlier), F.lit(0))
    left_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    level = weighed.withColumn("level", left / left_weight.cast("double"))
    level = level.withColumn("below", F.col("bound") >= F.col("level") * F.col("weight"))
    level = level.withColumn("level", F.min(F.when(F.col("below"), F.struct(F.col("bound") / F.col("weight"), "level"))).over(all_rows)["level"])
    return level.select(
        "source", "source_size",
        F.least(F.col("bound").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound").cast("double"))).alias("target"),
    )


def _rate(most: int) -> Column:
    power = F.least(F.col("m") * F.col("z"), F.lit(50.0))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(power)))


def _solve(cells: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Multiplier m of each source, by Newton steps kept inside a shrinking bracket.

    A source whose target is its bound takes every document `most` times (`full`).
    """
    cells = cut(
        cells.join(targets, cells["source"].eqNullSafe(targets["source"])).select(
            targets["source"], "size", "n", (F.col("size") / F.col("scale")).alias("z"),
        ), "mix-cells",
    )
    state = targets.select(
        F.col("source").alias("of"), "target", (F.col("target") >= F.col("source_size") * most * (1 - CLOSE)).alias("full"),
        F.lit(0.0).alias("m"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(False).alias("done"),
    )
    state = cut(state, "mix-state")
    for _ in range(MOST_STEPS):
        rate = _rate(most)
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, tokens * F.col("z")).otherwise(0.0)
        sums = cells.join(state, cells["source"].eqNullSafe(state["of"])).groupBy("of").agg(
            F.sum(_exact(tokens)).cast("double").alias("tokens"), F.sum(_exact(slope)).cast("double").alias("slope"),
        )
        gap = F.col("tokens") - F.col("target")
        low = F.when(gap <= 0, F.col("m")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("m")).otherwise(F.col("high"))
        step = F.col("m") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (step > F.col("low")) & (step < F.col("high"))
        bounded = (F.col("low") > -1e9) & (F.col("high") < 1e9)
        halved = F.when(bounded, (F.col("low") + F.col("high")) / 2).otherwise(
            F.when(gap > 0, F.col("m") * 2 - 1).otherwise(F.col("m") * 2 + 1))
        moved = F.when(F.coalesce(inside, F.lit(False)) & (F.abs(step - F.col("m")) < 20), step).otherwise(halved)
        done = F.col("done") | F.col("full") | (F.abs(gap) <= F.col("target") * CLOSE)
        state = cut(
            state.join(sums.withColumnRenamed("of", "with"), F.col("of").eqNullSafe(F.col("with"))).withColumns({"low": low, "high": high})
            .select("of", "target", "full", F.when(done, F.col("m")).otherwise(F.round(moved, 12)).alias("m"), "low", "high", done.alias("done")),
            "mix-state",
        )
        if state.where(~F.col("done")).isEmpty():
            break
    return cells.join(state, cells["source"].eqNullSafe(state["of"])).select("source", "size", "n", "z", _rate(most).alias("rate"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    most: int = 3, weights: tuple[int, ...] = (1, 2, 3),
) -> DataFrame:
    """Copies of each document for a mix by source: doc_id, size, source_size, target, copies, taken.

    `copies` is the rate rounded down or up, so 0 to `most`. Roundings within a source follow the
    running sum of the rates in order of size, which keeps its tokens within one document's size of
    its target before the last step. `taken` is copies * size, but for some documents of the source, whose last
    copy is cut or lengthened, so that the source meets its target to the word where it has the room.
    A NULL source is a source of its own; NULL or empty texts have size 0 and are taken
    0 words. Equal rows are told apart by nothing but a number and may round differently;
    rows with a NULL id are allowed. An empty table gives an empty result.
    """
    sized = cut(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_tokens(text).alias("size"))
        .withColumn("slice", F.xxhash64(F.col("doc_id"), F.lit("mix"))), "mix-sizes",
    )
    cells = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    per_source = cells.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.greatest(F.max("size"), F.lit(1)).cast("double").alias("scale"),
    )
    targets = cut(
        source_targets(per_source.drop("scale"), most, weights).withColumnRenamed("source", "of")
        .join(per_source.drop("source_size"), F.col("of").eqNullSafe(F.col("source"))).drop("of"), "mix-targets",
    )
    rates = _solve(cells, targets, most)

    # Cells of many documents are cut into slices by a hash; a slice is a cell of its own from here.
    slices = F.ceil(F.col("n") / CELL_ROWS).cast("int")
    sliced = sized.join(
        cells.select(F.col("source").alias("s"), F.col("size").alias("z"), slices.alias("slices")),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")),
    ).select("doc_id", "source", "size", F.pmod("slice", "slices").alias("part"), "slice")
    cell = ["source", "size", "part"]
    small = cut(sliced.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "mix-slices")
    rate = rates.select(F.col("source").alias("s"), F.col("size").alias("z"), "rate")
    small = small.join(rate, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select(*cell, "n", "rate")

    whole = F.floor("rate")
    running = Window.partitionBy("source").orderBy("size", "part")
    ups = F.sum((F.col("n") * (F.col("rate") - whole)).cast("decimal(28,9)")).over(running)
    small = small.withColumn("base", whole.cast("long")).withColumn("up", F.floor(ups + F.lit(0.5).cast("decimal(2,1)")).cast("long"))
    small = small.withColumn("up", F.col("up") - F.coalesce(F.lag("up").over(running), F.lit(0)))
    small = small.withColumn("up", F.least(F.greatest("up", F.lit(0)), F.col("n")))

    # What rounding left, per source: filled or cut in the cells of the longest documents first.
    plan = cut(small, "mix-plan")
    taken = plan.groupBy("source").agg(F.sum((F.col("n") * F.col("base") + F.col("up")) * F.col("size")).alias("got"))
    gaps = taken.withColumnRenamed("source", "s").join(targets.select(F.col("source").alias("t"), "target"), F.col("s").eqNullSafe(F.col("t"))) \
        .select("s", (F.round("target").cast("long") - F.col("got")).alias("gap"))
    room_up = (most * F.col("n") - F.col("n") * F.col("base") - F.col("up")) * F.col("size")
    room_down = (F.col("n") * F.col("base") + F.col("up")) * F.col("size")
    room = F.when(F.col("gap") > 0, room_up).otherwise(room_down)
    from_long = Window.partitionBy("source").orderBy(F.desc("size"), "part")
    plan = plan.join(gaps, F.col("source").eqNullSafe(F.col("s"))).withColumn("room", room)
    before = F.coalesce(F.sum("room").over(from_long.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.greatest(F.lit(0), F.least(F.col("room"), F.abs("gap") - before))
    plan = plan.select(*(F.col(c).alias(f"c_{c}") for c in cell), "base", "up", (share * F.signum("gap")).cast("long").alias("share"))

    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("part") == F.col("c_part"))
    in_cell = Window.partitionBy(*cell).orderBy("slice", "doc_id")
    ranked = sliced.join(plan, same).withColumn("k", F.row_number().over(in_cell))
    copies = F.col("base") + F.when(F.col("k") <= F.col("up"), 1).otherwise(0)
    ranked = ranked.withColumn("copies", copies)
    own = F.when(F.col("share") > 0, (most - F.col("copies")) * F.col("size")).otherwise(F.col("copies") * F.col("size"))
    used = F.coalesce(F.sum(own).over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    change = F.greatest(F.lit(0), F.least(own, F.abs("share") - used)) * F.signum("share")
    result = ranked.withColumn("taken", (F.col("copies") * F.col("size") + change).cast("long"))
    by_source = targets.select(F.col("source").alias("s"), "source_size", "target")
    return result.join(by_source, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", F.col("source"), "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), "taken",
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that a mix takes, once each, with the columns they came with and `copies`.

    A document is in if it is taken at all. Rows with the same id share the highest count. Beside a column `copies` of
    the documents the new one has an underscore before its name.
    """
    name, of, taken = (fresh(c, docs.columns) for c in ("copies", "of", "taken"))
    dealt = mix(docs, doc_id, **options).groupBy(F.col("doc_id").alias(of)).agg(F.max("taken").alias(taken), F.max("copies").alias(name))
    return docs.join(dealt, docs[doc_id].eqNullSafe(F.col(of))).where(F.col(taken) > 0).drop(of, taken)
