"""The distribution of an outcome column, and a ranked scan over a grid of settings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from fathomline.functions import values as V
from fathomline.operators.quantiles import quantiles

PERCENTILES = (5, 25, 50, 75, 95)
TESTS = (">=", ">", "<=", "<")
BINS = (2, 100)
# Candidates of a scan that one task sorts.
TASK_ROWS = 1_000_000


def distribution_summary(
    df: DataFrame,
    *,
    column: str,
    group_by=None,
    thresholds: dict[str, dict] | None = None,
    blocks: bool | None = None,
) -> DataFrame:
    """Moments, percentiles and threshold probabilities, in total or per group."""
    groups = V.names(group_by)
    V.need(df, column, *groups)
    rows = df.select(*[V.col(df, g) for g in groups], V.number(df, column).alias("_v")).where(
        F.col("_v").isNotNull()
    )
    v, made = F.col("_v"), []
    for name, spec in (thresholds or {}).items():
        op, bound = V.one_of("threshold operator", spec.get("op", ">="), TESTS), F.lit(float(spec["value"]))
        hit = {">=": v >= bound, ">": v > bound, "<=": v <= bound, "<": v < bound}[op]
        made.append(F.round(F.avg(hit.cast("double")), 6).alias(f"p_{name}"))
    out = rows.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(
        F.count(v).alias("trials"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.stddev_pop(v), 6).alias("stdev"),
        F.round(F.min(v), 6).alias("min"),
        F.round(F.max(v), 6).alias("max"),
        *made,
    )
    q = quantiles(
        rows, v, [p / 100 for p in PERCENTILES], group_by=groups, output="_q", blocks=blocks
    )
    if groups:
        q = q.withColumnsRenamed({g: f"_j_{g}" for g in groups})
        same = V.every([F.col(f"`{g}`").eqNullSafe(F.col(f"`_j_{g}`")) for g in groups])
        out = out.join(q, same).drop(*[f"_j_{g}" for g in groups])
    else:
        out = out.withColumn("_q", q.select("_q").scalar())
    return out.withColumns(
        {f"p{p}": F.round(F.col("_q")[i], 6) for i, p in enumerate(PERCENTILES)}
    ).drop("_q")


def outcome_histogram(df: DataFrame, *, column: str, bins: int = 20) -> DataFrame:
    """Buckets with their share of all outcomes."""
    if not BINS[0] <= bins <= BINS[1]:
        raise ValueError(f"bins must lie between {BINS[0]} and {BINS[1]}")
    v = V.number(df, column)
    both = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high"))).scalar()
    width = (both["high"] - both["low"]) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((v - both["low"]) / width))
    )
    counts = df.where(v.isNotNull()).groupBy(at.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("trials")
    )
    grid = df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("all"))
    grid = grid.withColumn(
        "bucket",
        F.explode(F.when(F.col("low") < F.col("high"), F.sequence(F.lit(0), F.lit(bins - 1)))
                  .when(F.col("low").isNotNull(), F.array(F.lit(0)))),
    ).withColumn("_w", (F.col("high") - F.col("low")) / bins)
    trials = F.coalesce("trials", F.lit(0))
    return grid.join(counts, "bucket", "left").select(
        F.col("bucket").cast("bigint").alias("bucket"),
        F.round(F.col("low") + F.col("_w") * F.col("bucket"), 6).alias("lower"),
        F.round(F.col("low") + F.col("_w") * (F.col("bucket") + 1), 6).alias("upper"),
        trials.alias("trials"),
        F.round(trials / F.col("all"), 6).alias("share"),
    )


def settings(spec, name: str) -> list:
    """The values of one variable: a list, choices, or min, max and step."""
    if isinstance(spec, dict) and "choices" in spec:
        spec = spec["choices"]
    if isinstance(spec, (list, tuple)):
        if not spec:
            raise ValueError(f"variable {name!r} has no values")
        return list(spec)
    low, high, step = float(spec["min"]), float(spec["max"]), float(spec.get("step") or 1.0)
    if high < low or step <= 0:
        raise ValueError(f"variable {name!r} needs max at or above min, and a positive step")
    return [round(low + i * step, 10) for i in range(math.floor((high - low) / step) + 1)]


def _candidates(df, variables, derived, constraints, objective):
    if not variables or not objective:
        raise ValueError("a scan needs variables and an objective")
    each = {n: settings(s, n) for n, s in variables.items()}
    out = df
    for name, options in each.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    for name, expression in (derived or {}).items():
        out = out.withColumn(name, F.expr(expression))
    kept = [F.coalesce(F.expr(f"({c})").cast("boolean"), F.lit(False)) for c in constraints or []]
    # A candidate whose constraint or objective cannot be read is failed, not rejected.
    unread = [F.expr(f"({c})").isNull() for c in constraints or []]
    failed = reduce(lambda a, b: a | b, unread, F.lit(False))
    passes = V.every(kept)
    score = F.expr(objective).cast("double")
    return out.withColumns(
        {
            "objective": F.round(F.when(passes, score), 6),
            "_failed": failed | (passes & (score.isNull() | F.isnan(score))),
            "_rejected": ~failed & ~passes,
        }
    )


def scan_grid(
    df: DataFrame,
    *,
    subject,
    variables: dict,
    objective: str,
    derived: dict[str, str] | None = None,
    constraints: list[str] | None = None,
    goal: str = "maximise",
    top: int = 10,
) -> DataFrame:
    """The best settings per subject row, out of the product of all variables.

    A subject's candidates arise from its own row and are cut to the best `top` in one task, of
    which there are as many as the candidates need.
    """
    subjects = V.names(subject)
    V.need(df, *subjects)
    V.one_of("goal", goal, ("maximise", "minimise"))
    if top < 1:
        raise ValueError("top must be at least 1")
    scored = _candidates(df, variables, derived, constraints, objective)
    scored = scored.where(F.col("objective").isNotNull() & ~F.isnan("objective"))
    # As many tasks as keep a bounded number of candidates to sort in each.
    tasks = math.ceil(df.count() * math.prod(len(settings(s, n)) for n, s in variables.items()) / TASK_ROWS)
    scored = scored.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks), *[V.col(df, s) for s in subjects])
    best = F.col("objective").desc() if goal == "maximise" else F.col("objective").asc()
    w = Window.partitionBy(*[V.col(df, s) for s in subjects]).orderBy(
        best, *[F.col(f"`{v}`").asc() for v in variables]
    )
    ranked = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    return ranked.select(
        *[F.col(f"`{s}`") for s in subjects],
        F.col("_n").cast("bigint").alias("rank"),
        *[F.col(f"`{c}`") for c in [*variables, *(derived or {})]],
        "objective",
    )


def scan_counts(
    df: DataFrame,
    *,
    variables: dict,
    objective: str,
    derived: dict[str, str] | None = None,
    constraints: list[str] | None = None,
) -> DataFrame:
    scored = _candidates(df, variables, derived, constraints, objective)
    good = F.col("objective").isNotNull() & ~F.isnan("objective")
    return scored.agg(
        F.count(F.lit(1)).alias("search_space"),
        F.count_if(good).alias("evaluated"),
        F.count_if("_rejected").alias("rejected_by_constraints"),
        F.count_if("_failed").alias("failed_candidates"),
    )
