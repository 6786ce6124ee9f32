"""What was known of every asset at each of some moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.condition.features import LONG_WINDOW, SERIES
from fathomline.functions import values as V
from fathomline.operators.joins import as_of

# The share of progress that is more than noise, and repair memory.
NOTABLE_PROGRESS, NOTABLE_DEVIATION = 22.0, 8.0
MTBF_SHARE, LEAST_MEMORY_DAYS, DEFAULT_MTBF_DAYS = 0.05, 30.0, 1000.0
KEY = ["asset_id", "as_of"]


def whole_days(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(8.64e10))


def _first_told(at: Column, moments: list) -> Column:
    """The first moment at or after `at`; null if there is none."""
    return F.array_min(F.filter(_listed(moments), lambda m: m >= at))


def _listed(moments: list) -> Column:
    return F.array(*[F.lit(m).cast("timestamp") for m in moments])


def _held(states: DataFrame, keys: list[str], since: str, moments: list) -> DataFrame:
    """States, one per key and time, handed to the moments from their own time until the next state."""
    following = F.lead(since).over(Window.partitionBy(*keys).orderBy(since))
    until = F.col("_until")
    mine = F.filter(_listed(moments), lambda m: (m >= F.col(since)) & (until.isNull() | (m < until)))
    return states.withColumn("_until", following).withColumn("as_of", F.explode(mine)).drop("_until")


def measurements(
    features: DataFrame, moments: list, quality: DataFrame | None = None, *,
    blocks: bool | None = None,
) -> DataFrame:
    """Per asset, parameter and moment: the latest daily row, with its data quality."""
    latest = as_of(features, keys=SERIES, time="day", moments=moments, blocks=blocks)
    if quality is None:
        return latest.withColumns(
            {"quality_score": F.lit(None).cast("double"), "issues": F.lit("")}
        )
    return latest.join(quality.select(*SERIES, "quality_score", "issues"), SERIES, "left")


def facts(features: DataFrame, maintenance: DataFrame, moments: list) -> DataFrame:
    """Per asset and moment: days observed, running hours, days since the last repair.

    Days become running states, and a moment takes the last state before it: the history is read once,
    however many moments there are. Rows without a day or a repair date are left out.
    """
    per_day = features.select("*", F.to_timestamp("day").alias("_t")).where("_t IS NOT NULL").groupBy(
        "asset_id", "_t"
    ).agg(
        F.max("runtime_hours_total_max").alias("_rt"),
        F.min_by("sample_count", "parameter").alias("_s"),
        F.min("parameter").alias("_p"),
    )
    # A partition here holds one asset's days, which the calendar bounds.
    days = Window.partitionBy("asset_id").orderBy("_t")
    upto = days.rowsBetween(Window.unboundedPreceding, 0)
    day = F.struct("_s", "_p", F.row_number().over(days).alias("i"))
    running = per_day.withColumn("_day", day).withColumns(
        {
            "observed_days": F.count(F.lit(1)).over(upto),
            "runtime_hours_total": F.max(F.coalesce("_rt", F.lit(0.0))).over(upto),
            "_first": F.min("_p").over(upto),
            "_week": F.collect_list("_day").over(days.rowsBetween(-6, 0)),
        }
    )
    # The first day of all has no day before it to count from.
    counted = F.filter("_week", lambda e: (e["i"] > 1) & (e["_p"] == F.col("_first")))
    week = F.aggregate(counted, F.lit(0).cast("long"), lambda n, e: n + F.coalesce(e["_s"], F.lit(0)))
    states = running.select(
        "asset_id", "_t", "observed_days", "runtime_hours_total", week.cast("double").alias("runtime_hours_7d")
    )
    seen = _held(states, ["asset_id"], "_t", moments).drop("_t")

    at = V.moment(maintenance, "maintenance_date")
    # One row per asset and moment that repairs came before; a busy asset is combined on the map side.
    told = maintenance.where(F.col("maintenance_type") == "corrective").select(
        "asset_id", at.alias("_at"), _first_told(at, moments).alias("_told")
    ).where("_told IS NOT NULL").groupBy("asset_id", "_told").agg(
        F.max("_at").alias("_fixed"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("asset_id").orderBy("_told").rowsBetween(Window.unboundedPreceding, 0)
    repairs = _held(
        told.withColumns({"corrective_count": F.sum("_n").over(earlier)}).drop("_n"), ["asset_id"], "_told", moments
    ).drop("_told")
    out = seen.join(repairs, KEY, "left")
    since = whole_days(F.col("as_of"), F.col("_fixed"))
    return out.withColumns(
        {
            "corrective_count": F.coalesce("corrective_count", F.lit(0)),
            "days_since_repair": since,
            "trend_window_is_clean": since.isNull() | (since >= LONG_WINDOW),
        }
    ).drop("_fixed")


def intervals(
    known: DataFrame, assets: DataFrame, policies: DataFrame, maintenance: DataFrame, moments: list
) -> DataFrame:
    """Per asset, moment and policy: how much of the maintenance interval is used.

    The last work that counts for a policy is a state of (asset, policy); a moment takes the last one before
    it. Without a record of the task the use is unknown, and stays so.
    """
    kinds = assets.select("asset_id", "asset_type")
    wanted = policies.select("policy_id", "asset_type", "task", "action_kind", "interval_hours", "interval_days")
    due = known.select(*KEY, "runtime_hours_total", "runtime_hours_7d").join(kinds, "asset_id").join(
        wanted, "asset_type"
    )
    at = V.moment(maintenance, "maintenance_date")
    done = maintenance.select(
        "asset_id", F.col("task").alias("_task"), F.col("action_kind").alias("_kind"),
        (F.col("maintenance_type") == "corrective").alias("_fix"),
        at.alias("_at"), _first_told(at, moments).alias("_told"),
    ).where("_told IS NOT NULL").groupBy("asset_id", "_task", "_kind", "_fix", "_told").agg(F.max("_at").alias("_at"))
    same = (
        F.coalesce(F.col("_task") == F.col("task"), F.lit(False))
        | F.coalesce((F.col("_kind") == F.col("action_kind")) & (F.col("action_kind") != ""), F.lit(False))
        | F.coalesce(F.col("_fix"), F.lit(False))
    )
    one = ["asset_id", "policy_id"]
    work = done.join(kinds, "asset_id").join(wanted, "asset_type").where(same).groupBy(*one, "_told").agg(
        F.max("_at").alias("last_done")
    )
    last = _held(work, one, "_told", moments).select(*KEY, "policy_id", "last_done")
    out = due.join(last, [*KEY, "policy_id"], "left")
    elapsed = F.greatest(F.lit(0.0), (F.unix_micros("as_of") - F.unix_micros("last_done")) / F.lit(8.64e10))
    daily = F.when(F.col("runtime_hours_7d") > 0, F.col("runtime_hours_7d") / 7).otherwise(F.lit(8.0))
    hours = F.least(F.col("runtime_hours_total"), elapsed * F.greatest(F.lit(1.0), daily))
    by_hours = F.col("interval_hours") > 0
    return out.withColumns(
        {
            "hours_since": F.when(by_hours & F.col("last_done").isNotNull(), hours),
            "days_since": whole_days(F.col("as_of"), F.col("last_done")),
        }
    ).withColumns(
        {
            "hours_used_pct": 100.0 * F.col("hours_since") / F.col("interval_hours"),
            "days_used_pct": F.when(F.col("interval_days") > 0, 100.0 * F.col("days_since") / F.col("interval_days")),
            "unrecorded": by_hours & F.col("last_done").isNull(),
        }
    )


def records(
    measured: DataFrame, known: DataFrame, used: DataFrame, assets: DataFrame, signatures: DataFrame
) -> DataFrame:
    """One flat record per asset and moment; rules and scorecards read it by name."""
    p = F.col("limit_progress_pct")
    ratio = F.when(
        (F.col("residual_roll_std7") > 0) & (F.col("residual_roll_std30") > 1e-9),
        F.col("residual_roll_std7") / F.col("residual_roll_std30"),
    )
    top = F.reverse(F.array_sort(F.collect_list(p)))
    summary = measured.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("measurement_count"),
        F.max("status_rank").alias("max_threshold_rank"),
        F.max(p).alias("worst_limit_progress_pct"),
        F.get(top, F.lit(1)).alias("second_limit_progress_pct"),
        F.max("deviation_pct").alias("worst_deviation_pct"),
        F.max("progress_roll_slope21").alias("worst_trend_slope_per_day"),
        F.max_by("progress_roll_r_squared21", "progress_roll_slope21").alias("worst_trend_fit"),
        F.max_by("parameter", "progress_roll_slope21").alias("worst_trend_parameter"),
        F.count_if(p >= NOTABLE_PROGRESS).alias("deviating_measurements"),
        F.max(ratio).alias("variability_ratio"),
        F.round(100.0 - F.max(F.when(F.col("unit") == "°C", p)), 2).alias("temperature_headroom_pct"),
        F.round(F.avg("load_pct_mean"), 2).alias("load_pct_mean"),
        F.round(F.avg("ambient_temperature_c_mean"), 2).alias("ambient_temperature_c"),
        F.min("quality_score").alias("min_quality_score"),
        F.round(F.avg("quality_score"), 2).alias("mean_quality_score"),
    )
    usage = used.groupBy(*KEY).agg(
        F.round(F.max("hours_used_pct"), 2).alias("interval_usage_pct"),
        F.count_if("unrecorded").alias("unrecorded_intervals"),
    )
    matched = signatures.groupBy(*KEY).agg(
        F.round(100.0 * F.max("match"), 2).alias("signature_match_pct")
    )
    out = (
        summary.join(known, KEY)
        .join(usage, KEY, "left")
        .join(matched, KEY, "left")
        .join(assets.select("asset_id", "asset_type", "criticality", "mtbf_hours"), "asset_id")
    )
    memory = F.greatest(
        F.lit(LEAST_MEMORY_DAYS),
        F.coalesce(F.col("mtbf_hours") / 24.0, F.lit(DEFAULT_MTBF_DAYS)) * MTBF_SHARE,
    )
    aged = F.round(F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col("days_since_repair") / memory)), 2)
    return out.withColumns(
        {
            "signature_match_pct": F.coalesce("signature_match_pct", F.lit(0.0)),
            "days_since_corrective": F.col("days_since_repair"),
            "recent_failure_score": F.when(F.col("corrective_count") > 0, aged).otherwise(F.lit(0.0)),
        }
    )


def widened(record: DataFrame, measured: DataFrame, parameters: list[str]) -> DataFrame:
    """The record with every parameter's own deviation, progress and rank."""
    cells = measured.groupBy(*KEY).pivot("parameter", parameters).agg(
        F.max("deviation_pct").alias("deviation_pct"),
        F.max("limit_progress_pct").alias("limit_progress_pct"),
        F.max("status_rank").alias("rank"),
    )
    return record.join(cells, KEY, "left")
