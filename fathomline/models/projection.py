"""When a measurement reaches its limits, and how far that answer can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.models.scorecard import shown
from fathomline.operators.windows import trailing_rows

DIRECTIONS = ("rising", "falling")
BASES = ("calculated", "estimated", "inferred", "unknown")
DAY = 86_400.0


def project(
    df: DataFrame,
    *,
    value: str,
    time: str,
    limits: list[dict],
    group_by=None,
    window: int = 30,
    direction: str = "rising",
    min_points: int = 5,
    min_r_squared: float = 0.35,
    horizon: float = 365.0,
    confidence_multiplier: float = 1.96,
    tie_break=None,
) -> DataFrame:
    """One row per group and limit.

    calculated: already past. estimated: a date with its earliest and latest.
    inferred: a direction, but a weak fit or too far off, so no date. unknown: not
    moving towards the limit.
    """
    groups = V.names(group_by)
    V.need(df, value, time, *groups)
    V.one_of("direction", direction, DIRECTIONS)
    if not limits or horizon <= 0:
        raise ValueError("a projection needs limits and a positive horizon")
    usable = df.select(
        *[V.col(df, g) for g in groups],
        V.number(df, value).alias("_y"),
        V.moment(df, time).alias("_at"),
        *[V.col(df, t).alias(f"_tie{i}") for i, t in enumerate(V.names(tie_break))],
    ).where(F.col("_y").isNotNull() & F.col("_at").isNotNull())
    ties = [f"_tie{i}" for i in range(len(V.names(tie_break)))]
    recent = trailing_rows(
        usable, k=max(2, window), group_by=groups, order_by=["_at", *ties]
    ).withColumn("_x", F.unix_micros("_at") / F.lit(DAY * 1e6))
    y, x = F.col("_y"), F.col("_x")
    fitted = recent.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(
        F.count(y).alias("_n"),
        F.max_by(F.struct("_y", "_at"), F.struct("_at", *ties)).alias("_last"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    return project_fits(fitted, groups, value, limits, direction, min_points, min_r_squared, horizon,
                    confidence_multiplier)


def project_fits(fitted, groups, value, limits, direction, min_points, min_r2, horizon, width):
    """Projections from the sums of fits (_n, _sxx, _syy, _sxy) and their _last reading."""
    n, sxx, syy, sxy = (F.col(c) for c in ("_n", "_sxx", "_syy", "_sxy"))
    slope = F.when((n >= 2) & (sxx > 0), sxy / sxx)
    residual = F.greatest(F.lit(0.0), syy - sxy * sxy / sxx)
    fits = fitted.withColumns(
        {
            "_b": slope,
            "_r2": F.when(slope.isNotNull() & (syy > 0), F.greatest(F.lit(0.0), 1 - residual / syy)),
            "_se": F.when(slope.isNotNull() & (n > 2), F.sqrt(residual / (n - 2) / sxx)),
            "_y": F.col("_last._y"),
            "_at": F.col("_last._at"),
        }
    )
    named = F.array(*[
        F.struct(
            F.lit(str(e.get("name") or f"limit {V.short(float(e['value']))}")).alias("name"),
            F.lit(float(e["value"])).alias("value"),
        )
        for e in limits
    ])
    each = fits.withColumn("_limit", F.explode(named))
    rising = direction == "rising"
    y, b, goal = F.col("_y"), F.col("_b"), F.col("_limit.value")
    beyond = (y >= goal) if rising else (y <= goal)
    towards = (b > 0) if rising else (b < 0)

    def reach(speed: Column) -> Column:
        days = F.try_divide(goal - y, speed)
        return F.when(days >= 0, days)

    each = each.withColumn("_days", F.when(~beyond & towards, reach(b)))
    days = F.col("_days")
    near = days <= F.lit(float(horizon))
    strong = (n >= min_points) & (F.col("_r2") >= min_r2)
    margin = F.lit(float(width)) * F.col("_se")
    sign = F.when(b > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    slowest = reach(b - sign * margin)
    dated = near & strong
    earliest = F.when(F.col("_se") == 0, days).otherwise(F.coalesce(reach(b + sign * margin), days))
    latest = F.when(F.col("_se") == 0, days).otherwise(
        F.when(slowest <= F.lit(float(horizon)), slowest)
    )
    basis = (
        F.when(beyond, "calculated")
        .when(dated, "estimated")
        .when(days.isNotNull(), "inferred")
        .otherwise("unknown")
    )

    def day_after(count: Column) -> Column:
        moved = F.timestamp_micros(F.unix_micros("_at") + (count * F.lit(DAY * 1e6)).cast("bigint"))
        return F.date_format(moved, "yyyy-MM-dd")

    name = F.col("_limit.name")
    reason = (
        F.when(beyond, F.concat(F.lit("at or past "), name, F.lit(": "), shown(y), F.lit(" against "), shown(goal)))
        .when(b.isNull(), F.lit("too few readings for a trend"))
        .when(~towards, F.concat(F.lit("not moving towards "), name))
        .when(days.isNull(), F.lit("the trend does not reach the limit"))
        .when(~near, F.lit(f"further off than {V.short(horizon)} days"))
        .when(~strong, F.concat(F.lit("moving towards "), name, F.lit(", but the fit is weak")))
        .otherwise(F.concat(F.lit("about "), F.format_string("%.0f", days), F.lit(" days from "), name))
    )
    return each.select(
        *[F.col(f"`{g}`") for g in groups],
        F.lit(value).alias("measurement"),
        name.alias("limit"),
        goal.alias("limit_value"),
        y.alias("current_value"),
        F.date_format("_at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"),
        F.round(b, 8).alias("slope_per_day"),
        F.round("_r2", 4).alias("r_squared"),
        n.alias("readings_used"),
        F.when(beyond, F.lit(0.0)).when(near, F.round(days, 2)).alias("days_to_limit"),
        F.when(~beyond & dated & F.col("_se").isNotNull(), F.round(earliest, 2)).alias("days_earliest"),
        F.when(~beyond & dated & F.col("_se").isNotNull(), F.round(latest, 2)).alias("days_latest"),
        F.when(beyond, F.date_format("_at", "yyyy-MM-dd")).when(dated, day_after(days)).alias("projected_date"),
        F.when(~beyond & dated & F.col("_se").isNotNull(), day_after(earliest)).alias("projected_earliest"),
        F.when(~beyond & dated & F.col("_se").isNotNull(), day_after(latest)).alias("projected_latest"),
        basis.alias("basis"),
        reason.alias("reason"),
    )


def projection_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("projections"),
        *[F.count_if(F.col("basis") == b).alias(f"basis_{b}") for b in BASES],
    )
