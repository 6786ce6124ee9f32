"""Runs compared: leaderboards, targets, metric tables, and what a run observed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from fathomline.functions import values as V
from fathomline.operators.ordered import position
from fathomline.operators.rows import latest_per_key
from fathomline.plans.compose import run_plan

DIRECTIONS = ("higher", "lower")


def latest_runs(runs: DataFrame, *, trial, order_by) -> DataFrame:
    """The newest run of every trial."""
    return latest_per_key(runs, keys=trial, order_by=order_by)


def leaderboard(
    runs: DataFrame, *, experiment: str, trial: str, primary: str, order_by, direction: str = "higher",
    blocks: bool | None = None,
) -> DataFrame:
    """Latest run per trial, best first in its experiment; trials without the metric last."""
    V.one_of("direction", direction, DIRECTIONS)
    latest = latest_runs(runs, trial=[experiment, trial], order_by=order_by)
    scored = latest.withColumn("primary_value", V.number(latest, primary))
    best = "-primary_value" if direction == "higher" else "primary_value"
    return position(scored, "place", group_by=[experiment], order_by=[best, trial], blocks=blocks)


def compare_runs(
    metrics: DataFrame, *, experiment: str, trial: str, metric: str, value: str, shared: str,
    direction: str = "higher", blocks: bool | None = None,
) -> DataFrame:
    """(experiment, trial) with one column per metric found, ranked by a shared one over all.

    Metric names come to the driver; they are columns of the answer.
    """
    V.one_of("direction", direction, DIRECTIONS)
    names = [r[0] for r in metrics.select(V.col(metrics, metric)).distinct().orderBy(metric).collect()]
    if shared not in names:
        raise ValueError(f"no run measured {shared!r}; metrics are {names}")
    wide = metrics.groupBy(V.col(metrics, experiment), V.col(metrics, trial)).pivot(metric, names).agg(
        F.max(V.number(metrics, value))
    )
    best = f"-{shared}" if direction == "higher" else shared
    return position(wide, "place", order_by=[best, experiment, trial], blocks=blocks)


def check_target(df: DataFrame, *, metric: str, least: float | None = None, most: float | None = None,
                 output: str = "verdict") -> DataFrame:
    """pass, fail, or unknown where the metric has no value."""
    if least is None and most is None:
        raise ValueError("a target needs a least or a most")
    v = V.number(df, metric)
    met = F.lit(True)
    if least is not None:
        met = met & (v >= F.lit(float(least)))
    if most is not None:
        met = met & (v <= F.lit(float(most)))
    return df.withColumn(output, F.when(v.isNull(), "unknown").when(met, "pass").otherwise("fail"))


def run_observed(
    spec: list, source: DataFrame, write: Callable[[str, DataFrame], None], **options
) -> DataFrame:
    """Runs a plan, writes each of its outputs, and tells per output its rows and time.

    Rows are counted while they are written, not by a second job.
    """
    spark, out = source.sparkSession, []
    for name, df in run_plan(spec, source, **options).items():
        seen, began = Observation(f"step-{name}"), time.monotonic()
        status, rows = "succeeded", None
        try:
            write(name, df.observe(seen, F.count(F.lit(1)).alias("rows")))
            rows = seen.get["rows"]
        except Exception as e:
            status = f"failed: {type(e).__name__}"
        out.append((name, status, rows, round(time.monotonic() - began, 3)))
    return spark.createDataFrame(out, "step string, status string, rows bigint, seconds double")
