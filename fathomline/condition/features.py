"""Readings of running equipment as daily features: expected value, limit progress, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.operators.joins import join
from fathomline.operators.ordered import needs_blocks, over_rows
from fathomline.operators.reshape import resample_time
from fathomline.operators.rows import drop_duplicates, filter_rows, latest_per_key, rule
from fathomline.operators.windows import rolling_together

# Window lengths in days, states that count as running, daily measures.
SHORT_WINDOW, LONG_WINDOW, BASELINE_WINDOW = 7, 21, 30
RUNNING = ("running", "overload")
SERIES = ["asset_id", "parameter"]
DAILY_KEYS = ["asset_id", "asset_type", "site_id", "criticality", "parameter", "unit"]
DAILY = {
    "value": ["mean", "max", "min", "std"],
    "load_pct": ["mean", "max"],
    "ambient_temperature_c": ["mean"],
    "runtime_hours_total": ["max"],
    "start_count_total": ["max"],
}


def condition_readings(
    telemetry: DataFrame, operating: DataFrame, assets: DataFrame, environment: DataFrame, *,
    tie_break="sensor_id",
) -> DataFrame:
    """One trusted reading per sensor and moment, of machines that are running."""
    once = drop_duplicates(
        telemetry, columns=["timestamp", "asset_id", "parameter"], order_by=tie_break
    )
    # Filters on the duplicates' quality must follow the choice of the reading kept.
    kept = filter_rows(once, column="quality", op="not_equals", value="no_data")
    kept = filter_rows(kept, column="quality", op="not_equals", value="bad")
    running = filter_rows(operating, column="operating_state", op="in", value=list(RUNNING))
    out = join(
        kept, running, on=["timestamp", "asset_id"],
        columns=["operating_state", "load_pct", "runtime_hours_total", "start_count_total"],
    )
    out = join(out, assets, on="asset_id", columns=["asset_type", "site_id", "criticality"])
    return join(
        out, environment, on=["timestamp", "site_id"],
        columns=["ambient_temperature_c", "relative_humidity_pct"],
    )


def daily_readings(readings: DataFrame) -> DataFrame:
    return resample_time(
        readings, timestamp="timestamp", period="day", output="day", group_by=DAILY_KEYS,
        measures=DAILY, sort=False,
    )


def residuals(daily: DataFrame, response: DataFrame, thresholds: DataFrame) -> DataFrame:
    """What load and weather explain, what is left, and how near the limits that is."""
    out = join(
        daily, response, on=["asset_type", "parameter"], how="left",
        columns=["intercept", "load_coefficient", "ambient_coefficient", "direction", "direction_sign"],
    )
    out = join(
        out, thresholds, on=["asset_type", "parameter"], how="left",
        columns=["warning_offset", "critical_offset", "emergency_offset", "reference_value"],
    )
    sign = F.col("direction_sign")
    out = out.withColumn(
        "expected",
        F.col("intercept") + F.col("load_coefficient") * F.col("load_pct_mean") / 100.0
        + F.col("ambient_coefficient") * F.col("ambient_temperature_c_mean"),
    ).withColumn("residual", F.col("value_mean") - F.col("expected"))
    out = out.withColumns(
        {
            "deviation_pct": sign * 100.0 * F.col("residual") / (F.abs("expected") + 1e-6),
            "excess": sign * F.col("residual"),
            **{f"{k}_excess": sign * F.col(f"{k}_offset") for k in ("warning", "critical", "emergency")},
            **{f"{k}_value": F.col("expected") + F.col(f"{k}_offset")
               for k in ("warning", "critical", "emergency")},
        }
    ).withColumn("limit_progress_pct", 100.0 * F.col("excess") / (F.col("emergency_excess") + 1e-6))
    levels = [
        {"name": k, "when": f"excess >= {k}_excess", "then": {"status": k, "status_rank": r}}
        for k, r in (("emergency", 3), ("critical", 2), ("warning", 1))
    ]
    return rule(out, rules=levels, default={"status": "normal", "status_rank": 0}).drop("matched_rules")


def trends(features: DataFrame, *, blocks: bool | None = None) -> DataFrame:
    """Rolling level, spread, slope and fit per series; all share one ordering."""
    blocks = needs_blocks(features, SERIES, blocks)

    def rolled(column, window, statistics, least, prefix, per="hour"):
        return {"column": column, "window": window, "statistics": statistics, "min_periods": least,
                "prefix": prefix, "per": per}

    wanted = [
        rolled("residual", SHORT_WINDOW, ["mean", "std"], 3, "residual_roll"),
        rolled("residual", LONG_WINDOW, ["slope", "zscore"], 6, "residual_roll", "day"),
        rolled("limit_progress_pct", LONG_WINDOW, ["slope", "r_squared"], 6, "progress_roll", "day"),
        rolled("residual", BASELINE_WINDOW, ["std"], 10, "residual_roll"),
    ]
    x, y = F.unix_micros("day") / F.lit(8.64e10), F.col("limit_progress_pct")

    def line(w):
        # The sums a projection from this day on needs, over the last rows of its series.
        w = w.rowsBetween(1 - LONG_WINDOW, 0)
        return {
            "line_n": F.regr_count(y, x).over(w), "line_sxx": F.regr_sxx(y, x).over(w),
            "line_syy": F.regr_syy(y, x).over(w), "line_sxy": F.regr_sxy(y, x).over(w),
        }

    out = features.withColumn("day", V.moment(features, "day"))
    # The line first: it needs the order of days, which the numbering of values takes over from it.
    out = over_rows(out, line, group_by=SERIES, order_by="day", before=LONG_WINDOW - 1, blocks=blocks)
    out = rolling_together(out, wanted, group_by=SERIES, order_by="day", blocks=blocks)
    names = [f"{w['prefix']}_{how}{w['window']}" for w in wanted for how in w["statistics"]]
    lines = ["line_n", "line_sxx", "line_syy", "line_sxy"]
    out = out.select(*features.columns, *names, *lines)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def fleet_snapshot(features: DataFrame) -> DataFrame:
    """The newest day of every series."""
    return latest_per_key(features, keys=SERIES, order_by="day")
