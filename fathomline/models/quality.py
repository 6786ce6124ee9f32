"""One row per series: what is wrong with its readings, and a 0-100 score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.operators.quantiles import quantiles
from fathomline.operators.windows import half_drift, level_shift, longest_runs, sampling_gaps
from fathomline.session import has_hot_group

CHECKS = ("missing", "duplicates", "range", "outliers", "flatline", "step", "gaps", "drift")
# What each fault may take off the score, and the flag's lower bounds.
PENALTY = {
    "missing": 60.0,
    "duplicates": 20.0,
    "range": 100.0,
    "outliers": 40.0,
    "flatline": 45.0,
    "step": 50.0,
    "gaps": 25.0,
    "drift": 10.0,
}
FLAGS = (("good", 90.0), ("acceptable", 70.0), ("suspect", 40.0))


def _attach(base: DataFrame, part: DataFrame, groups: list[str]) -> DataFrame:
    part = part.withColumnsRenamed({g: f"_j_{g}" for g in groups})
    same = V.every([F.col(f"`{g}`").eqNullSafe(F.col(f"`_j_{g}`")) for g in groups])
    if not groups:
        # Both sides are the one row of an ungrouped aggregate.
        base, part, same = base.withColumn("_1", F.lit(1)), part.withColumn("_2", F.lit(1)), (
            F.col("_1") == F.col("_2"))
    return base.join(part, same, "left").drop(*[f"_j_{g}" for g in groups], "_1", "_2")


def data_quality(
    df: DataFrame,
    *,
    value: str,
    timestamp: str,
    group_by=None,
    tie_break=None,
    checks=CHECKS,
    ranges: dict[str, dict] | DataFrame | None = None,
    range_key: str | None = None,
    expected_interval_minutes: float | None = None,
    gap_tolerance: float = 2.0,
    flatline_readings: int = 6,
    step_ratio: float = 12.0,
    outlier_factor: float = 3.0,
    drift_sigma: float = 3.0,
    min_score: float = 0.0,
    blocks: bool | None = None,
) -> DataFrame:
    groups, wanted = V.names(group_by), V.names(checks)
    V.need(df, value, timestamp, *groups)
    for c in wanted:
        V.one_of("check", c, CHECKS)
    ties = V.names(tie_break)
    keep = list(dict.fromkeys([*groups, *ties, *([range_key] if range_key else [])]))
    rows = df.select(
        *[V.col(df, c) for c in keep if c not in ("_y", "_at")],
        V.number(df, value).alias("_y"), V.moment(df, timestamp).alias("_at"),
    )
    order = ["_at", *ties]
    if blocks is None:
        blocks = bool(groups) and has_hot_group(rows, groups)
    rows = _limits(rows, ranges, range_key)
    by = [F.col(f"`{g}`") for g in groups]
    y = F.col("_y")
    out_of = (y < F.col("_low")) | (y > F.col("_high"))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("readings"),
        F.count("_y").alias("present"),
        (F.count("_at") - F.count_distinct("_at")).alias("duplicates"),
        F.count_if(out_of).alias("out_of_range"),
    )
    base = base.withColumn("missing", F.col("readings") - F.col("present"))
    present = rows.where(y.isNotNull())

    if "outliers" in wanted:
        q = quantiles(present, y, [0.25, 0.75], group_by=groups, output="_q", blocks=blocks)
        spread = F.col("_q")[1] - F.col("_q")[0]
        far = (y < F.col("_q")[0] - outlier_factor * spread) | (
            y > F.col("_q")[1] + outlier_factor * spread
        )
        counted = _attach(present, q, groups).groupBy(*by).agg(
            F.count_if(far & (spread > 0)).alias("outliers")
        )
        base = _attach(base, counted, groups)
        base = base.withColumn(
            "outliers", F.when(F.col("present") >= 8, F.coalesce("outliers", F.lit(0))).otherwise(0)
        )
    else:
        base = base.withColumn("outliers", F.lit(0).cast("bigint"))
    runs = longest_runs(rows, column="_y", group_by=groups, order_by=order, blocks=blocks)
    base = _attach(base, runs, groups)
    nothing = F.lit(None).cast("double")
    if "step" in wanted:
        steps = level_shift(
            rows, column="_y", group_by=groups, order_by=order, least=40, output="_step",
            blocks=blocks,
        )
        base = _attach(base, steps, groups)
    else:
        base = base.withColumn("_step", nothing)
    if "gaps" in wanted and expected_interval_minutes:
        gaps = sampling_gaps(
            rows, time="_at", group_by=groups, interval_minutes=expected_interval_minutes,
            tolerance=gap_tolerance, tie_break=ties, blocks=blocks,
        )
        base = _attach(base, gaps, groups)
    else:
        base = base.withColumns(
            {"intervals": F.lit(0), "gaps": F.lit(0).cast("bigint"), "largest_gap_minutes": nothing}
        )
    if "drift" in wanted:
        drift = half_drift(
            rows, column="_y", group_by=groups, order_by=order, output="_drift", least=10,
            blocks=blocks,
        )
        base = _attach(base, drift, groups)
    else:
        base = base.withColumn("_drift", nothing)
    return _scored(base, groups, value, wanted, flatline_readings, step_ratio, drift_sigma, min_score)


def _limits(rows: DataFrame, ranges, range_key) -> DataFrame:
    """Physical limits per series label: a literal map, or a table (key, min, max)."""
    nothing = F.lit(None).cast("double")
    if ranges is None or not range_key:
        return rows.withColumns({"_low": nothing, "_high": nothing})
    label = F.col(f"`{range_key}`").cast("string")
    if isinstance(ranges, DataFrame):
        table = ranges.toDF("_label", "_low", "_high")
        return rows.join(table, label == F.col("_label"), "left").drop("_label")

    def side(name: str):
        pairs = [
            x for k, v in ranges.items() if v.get(name) is not None
            for x in (F.lit(str(k)), F.lit(float(v[name])))
        ]
        return F.create_map(*pairs)[label] if pairs else nothing

    return rows.withColumns({"_low": side("min"), "_high": side("max")})


def _scored(base, groups, value, wanted, flatline, step_ratio, drift_limit, min_score):
    def share(a: str, b: str, times: float) -> Column:
        # Multiplied first: what a quotient loses would tip halves when it is rounded.
        return F.coalesce(F.try_divide(F.lit(times) * F.col(a), F.col(b)), F.lit(0.0))

    best, step, drift = F.col("longest_flatline"), F.round("_step", 5), F.col("_drift")
    missing_pct = F.round(share("missing", "readings", 100.0), 3)
    loss = {
        "missing": share("missing", "readings", PENALTY["missing"]),
        "duplicates": F.least(F.lit(PENALTY["duplicates"]), PENALTY["duplicates"] * F.col("duplicates") / 10),
        "range": share("out_of_range", "present", PENALTY["range"]),
        "outliers": share("outliers", "present", PENALTY["outliers"]),
        "flatline": F.when(
            best >= flatline,
            PENALTY["flatline"] * F.least(F.lit(1.0), best / F.lit(max(24.0, 4.0 * flatline))),
        ),
        "step": F.when(
            step >= step_ratio,
            PENALTY["step"] * F.least(F.lit(1.0), (step - step_ratio) / (2 * step_ratio) + 0.5),
        ),
        "gaps": PENALTY["gaps"] * F.least(F.lit(1.0), share("gaps", "intervals", 4.0)),
        "drift": F.when(drift >= drift_limit, F.lit(PENALTY["drift"])),
    }
    found = {
        "missing": (missing_pct >= 5, F.concat(F.format_string("%.1f", missing_pct), F.lit("% of readings missing"))),
        "duplicates": (F.col("duplicates") > 0, F.concat(F.col("duplicates"), F.lit(" repeated timestamps"))),
        "range": (F.col("out_of_range") > 0, F.concat(F.col("out_of_range"), F.lit(" readings outside the physical range"))),
        "outliers": (F.col("outliers") > 0, F.concat(F.col("outliers"), F.lit(" readings far from the usual spread"))),
        "flatline": (best >= flatline, F.concat(best, F.lit(" identical readings in a row"))),
        "step": (step >= step_ratio, F.concat(F.lit("level shifted by "), F.format_string("%.0f", step), F.lit(" times the noise"))),
        "gaps": (F.col("gaps") > 0, F.concat(F.col("gaps"), F.lit(" sampling gaps"))),
        "drift": (drift >= drift_limit, F.concat(F.lit("halves differ by "), F.format_string("%.1f", drift), F.lit(" sigma"))),
    }
    left = reduce(lambda a, c: a - F.coalesce(loss[c], F.lit(0.0)), [c for c in CHECKS if c in wanted], F.lit(100.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), left))
    flag = None
    for name, least in FLAGS:
        hit = F.col("_score") >= least
        flag = F.when(hit, F.lit(name)) if flag is None else flag.when(hit, F.lit(name))
    issues = F.array_compact(F.array(*[F.when(*found[c]) for c in CHECKS if c in wanted]))
    return base.withColumn("_score", score).select(
        *[F.col(f"`{g}`") for g in groups],
        F.lit(value).alias("measurement"),
        "readings", "present", "missing", missing_pct.alias("missing_pct"), "duplicates",
        "outliers", "out_of_range", best.cast("bigint").alias("longest_flatline"),
        F.round(step, 2).alias("largest_step_ratio"), "gaps", "largest_gap_minutes",
        F.round(drift, 3).alias("drift_sigma"),
        F.round("_score", 2).alias("quality_score"),
        flag.otherwise(F.lit("bad")).alias("quality_flag"),
        F.array_join(issues, ", ").alias("issues"),
        (F.col("_score") >= min_score).alias("usable"),
    )


def quality_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("series"),
        F.round(F.avg("quality_score"), 3).alias("mean_quality_score"),
        F.min("quality_score").alias("worst_quality_score"),
        F.count_if(~F.col("usable")).alias("unusable"),
        *[F.count_if(F.col("quality_flag") == n).alias(f"flag_{n}")
          for n in ("good", "acceptable", "suspect", "bad")],
    )
