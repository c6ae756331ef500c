"""Classification workloads on labelled documents, and scoring by given weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.operators import classify, newton
from benchloom.plans.registry import Registry
from benchloom.sources.tables import labelled_text, load, text_form

registry = Registry()
query = registry.query

WEIGHTS = {"l_quantity": 0.03, "l_discount": -4.0, "l_tax": 2.5}
BIAS = -0.6
_MARGIN = " + ".join([f"{BIAS}::DOUBLE", *(f"{c} * {w}::DOUBLE" for c, w in WEIGHTS.items())])


@query(f"""
    SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-z)), 6) AS score, (z > 0)::INT AS predicted
    FROM (SELECT *, {_MARGIN} AS z FROM lineitem)
""")
def score_logit(spark, d):
    scored = classify.linear_score(load(spark, d, "lineitem"), WEIGHTS, BIAS)
    return scored.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "predicted")


@query(f"""
    SELECT l_orderkey, l_linenumber, round(z, 6) + 0 AS score, (z > 0)::INT AS predicted
    FROM (SELECT *, {_MARGIN} AS z FROM lineitem)
""")
def score_margin(spark, d):
    scored = classify.linear_score(load(spark, d, "lineitem"), WEIGHTS, BIAS, link="none")
    return scored.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "predicted")


def _fit_and_score(fit, spark, d):
    """Held-out documents scored by a model of the others."""
    rows = labelled_text(load(spark, d, "documents"), load(spark, d, "labels"))
    train, test = classify.split_by_id(rows, "doc_id")
    return classify.score(fit(train), test, "doc_id", "label").withColumn("margin", F.round("margin", 4))


@query()
def logistic_regression(spark, d):
    return _fit_and_score(classify.fit_logistic, spark, d)


@query()
def linear_svm(spark, d):
    return _fit_and_score(classify.fit_svm, spark, d)


REG = 0.01

# Loss, slope and curvature by margin z and label y, as SQL.
_LOGISTIC = ("greatest(z, 0) - y * z + ln(1 + exp(-abs(z)))", "1 / (1 + exp(-z)) - y", "1 / (1 + exp(-z)) * (1 - 1 / (1 + exp(-z)))")
_SHORT = "greatest(0, 1 - (2 * y - 1) * z)"
_HINGE = (f"{_SHORT} * {_SHORT}", f"-2 * (2 * y - 1) * {_SHORT}", f"CASE WHEN {_SHORT} > 0 THEN 2 ELSE 0 END")


def _newton_sql(loss: tuple[str, str, str], steps: int, penalty_of_bias: float) -> str:
    """Newton steps for two features and a bias, unrolled; each solves its three equations by determinants."""
    x, names = ["size", "gaps", "1"], "abc"

    def det(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    curve = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    regs = [REG, REG, REG * penalty_of_bias]
    ctes = ["w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for n in range(steps):
        slopes = ", ".join(f"sum(slope * {x[i]}) / count(*) + {regs[i]} * any_value({names[i]}) AS g{i}" for i in range(3))
        curves = ", ".join(f"sum(curve * {x[i]} * {x[j]}) / count(*) + {regs[i] if i == j else 0} AS h{i}{j}" for i in range(3) for j in range(i, 3))
        solved = ", ".join(
            f"{names[k]} - {det([[f'g{i}' if j == k else curve[i][j] for j in range(3)] for i in range(3)])} / {det(curve)} AS {names[k]}" for k in range(3)
        )
        ctes += [
            f"""s{n} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, {slopes}, {curves}
                FROM (SELECT *, {loss[1]} AS slope, {loss[2]} AS curve FROM (SELECT *, a * size + b * gaps + c AS z FROM r, w{n})))""",
            f"w{n + 1} AS MATERIALIZED (SELECT {solved} FROM s{n})",
        ]
    return f"""
        WITH f AS (
            SELECT doc_id, ln(1.0::DOUBLE + length(t)) AS size, (length(t) - length(replace(t, ' ', ''))) / (1.0::DOUBLE + length(t)) AS gaps
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        r AS MATERIALIZED (SELECT size, gaps, quality AS y FROM f JOIN labels USING (doc_id)), {", ".join(ctes)},
        w AS (FROM w{steps})"""


@query(f"""{_newton_sql(_LOGISTIC, 10, 0)}
    SELECT doc_id, round(a * size + b * gaps + c, 4) + 0 AS margin, round(1 / (1 + exp(-(a * size + b * gaps + c))), 4) AS probability FROM f, w
""")
def logistic_newton(spark, d):
    """Logistic regression of quality on the form of all labelled texts, and its score of every document."""
    rows = text_form(load(spark, d, "documents"))
    model = newton.fit_logistic(rows.join(load(spark, d, "labels"), "doc_id"), "quality", ["size", "gaps"], REG)
    return model.score(rows).select("doc_id", F.round("margin", 4).alias("margin"), F.round("probability", 4).alias("probability"))


@query(f"""{_newton_sql(_HINGE, 12, 1)},
    primal AS (SELECT avg(short * short) + {REG} / 2 * any_value(a * a + b * b + c * c) AS objective,
                      2 * avg(short) - avg(short * short) - (pow(2 * avg(short * sign * size), 2) + pow(2 * avg(short * sign * gaps), 2)
                      + pow(2 * avg(short * sign), 2)) / {2 * REG} AS dual
               FROM (SELECT *, 2 * y - 1 AS sign, {_SHORT} AS short FROM (SELECT *, a * size + b * gaps + c AS z FROM r, w)))
    SELECT doc_id, round(a * size + b * gaps + c, 4) + 0 AS margin, round(objective, 6) AS objective, objective - dual < 1e-6 AS certified
    FROM f, w, primal
""")
def svm_newton(spark, d):
    """Support vector machine on the same, with its objective and whether the duality gap certifies it."""
    rows = text_form(load(spark, d, "documents"))
    model = newton.fit_svm(rows.join(load(spark, d, "labels"), "doc_id"), "quality", ["size", "gaps"], REG)
    return model.score(rows).select(
        "doc_id", F.round("margin", 4).alias("margin"), F.lit(round(model.objective, 6)).alias("objective"), F.lit(model.gap < 1e-6).alias("certified"),
    )
