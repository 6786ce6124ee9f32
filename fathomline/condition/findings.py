"""Ten analyzers, each a table of findings with one schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.condition.features import LONG_WINDOW
from fathomline.condition.views import KEY, NOTABLE_DEVIATION, NOTABLE_PROGRESS
from fathomline.functions import values as V
from fathomline.operators.rows import top_per_group
from fathomline.session import null_on_failure

# The weights and limits of the analyzers.
STATUS_WEIGHT = {1: 18.0, 2: 34.0, 3: 52.0}
LEAST_SLOPE, WEAK_FIT = 0.15, 0.25
LEAST_Z, LEAST_RATIO = 2.0, 1.8
MATCH, CLEAR_MATCH, SUPPORT, FULL_PROGRESS, MODES_KEPT = 0.45, 0.6, 0.35, 50.0, 2
REPORTED_HOURS, REPORTED_DAYS = 70.0, 80.0
RECENT_REPAIR_DAYS, COLD_START_DAYS, TRUSTED_QUALITY = 45, 14, 70.0
COLUMNS = [*KEY, "analyzer", "category", "parameter", "failure_mode", "statement", "weight",
           "confidence", "action"]


def quality_factor(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(0.85)).otherwise(
        F.greatest(F.lit(0.3), F.least(F.lit(1.0), score / 100.0))
    )


def _finding(df: DataFrame, analyzer: str, category: str, statement: Column, weight, confidence, *,
             parameter: Column | None = None, mode: Column | None = None,
             action: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")

    def number(v) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast("double")

    return df.select(
        *[F.col(k) for k in KEY],
        F.lit(analyzer).alias("analyzer"),
        F.lit(category).alias("category"),
        (none if parameter is None else parameter).alias("parameter"),
        (none if mode is None else mode).alias("failure_mode"),
        statement.alias("statement"),
        number(weight).alias("weight"),
        number(confidence).alias("confidence"),
        (none if action is None else action).alias("action"),
    )


def _pct(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", c), F.lit("%"))


def threshold_findings(measured: DataFrame) -> DataFrame:
    rows = measured.where("status_rank >= 1")
    weights = F.create_map(*[F.lit(x) for kv in STATUS_WEIGHT.items() for x in kv])
    return _finding(
        rows, "threshold", "threshold",
        F.concat_ws(" ", "parameter", F.lit("is at its"), "status", F.lit("limit")),
        weights[F.col("status_rank")], 0.95 * quality_factor(F.col("quality_score")),
        parameter=F.col("parameter"),
        action=F.concat(F.lit("check "), F.col("parameter"), F.lit(" against its limit")),
    )


def baseline_findings(measured: DataFrame) -> DataFrame:
    p = F.col("limit_progress_pct")
    return _finding(
        measured.where(p >= NOTABLE_PROGRESS), "baseline", "baseline",
        F.concat(F.col("parameter"), F.lit(" has gone "), _pct(p), F.lit(" of the way to its emergency limit")),
        F.least(F.lit(26.0), 3.0 + p * 0.28), 0.75 * quality_factor(F.col("quality_score")),
        parameter=F.col("parameter"),
    )


def trend_findings(measured: DataFrame, known: DataFrame) -> DataFrame:
    """Series moving to their limit; none while the window straddles a repair."""
    rebuilt = _finding(
        known.where(~F.col("trend_window_is_clean")), "quality", "quality",
        F.concat(F.lit("repaired "), F.col("days_since_repair"),
                 F.lit(f" days ago, inside the {LONG_WINDOW}-day trend window")),
        -6.0, 0.85, action=F.lit("judge again once the window is past the repair"),
    )
    clean = measured.join(known.where("trend_window_is_clean").select(*KEY), KEY)
    slope, fit = F.col("progress_roll_slope21"), F.col("progress_roll_r_squared21")
    moving = clean.where(slope > LEAST_SLOPE)
    weak = fit < WEAK_FIT
    left = F.greatest(F.lit(0.0), (100.0 - F.col("limit_progress_pct")) / slope)
    weak = F.coalesce(weak, F.lit(False))
    out = _finding(
        moving, "trend", "trend",
        F.when(weak, F.concat(F.col("parameter"), F.lit(" rises on average, but within its noise")))
        .otherwise(F.concat(F.col("parameter"), F.lit(" moves "), F.format_string("%.2f", slope),
                            F.lit("% a day to its limit, about "), F.format_string("%.0f", left),
                            F.lit(" days off"))),
        F.when(weak, F.lit(4.0)).otherwise(F.least(F.lit(30.0), 6.0 + slope * 9.0)),
        F.when(weak, F.lit(0.4)).otherwise(
            F.least(F.lit(0.9), 0.45 + F.coalesce(F.nullif(fit, F.lit(0.0)), F.lit(0.5)) * 0.5)
            * quality_factor(F.col("quality_score"))
        ),
        parameter=F.col("parameter"),
    )
    return rebuilt.unionByName(out)


def statistical_findings(measured: DataFrame, known: DataFrame) -> DataFrame:
    clean = measured.join(known.where("trend_window_is_clean").select(*KEY), KEY)
    z = F.col("residual_roll_zscore21")
    far = _finding(
        clean.where(F.abs(z) >= LEAST_Z), "statistical", "statistical",
        F.concat(F.col("parameter"), F.lit(" is "), F.format_string("%+.1f", z), F.lit(" deviations from its own mean")),
        F.least(F.lit(20.0), 6.0 * F.abs(z) - 6.0), 0.7 * quality_factor(F.col("quality_score")),
        parameter=F.col("parameter"),
    )
    spread, usual = F.col("residual_roll_std7"), F.col("residual_roll_std30")
    ratio = spread / usual
    wild = _finding(
        clean.where((spread > 0) & (usual > 1e-9)).where(ratio >= LEAST_RATIO), "statistical", "statistical",
        F.concat(F.col("parameter"), F.lit(" varies "), F.format_string("%.1f", ratio), F.lit(" times as much as usual")),
        F.least(F.lit(16.0), 4.0 * ratio), 0.6 * quality_factor(F.col("quality_score")),
        parameter=F.col("parameter"),
    )
    return far.unionByName(wild)


def signature_matches(measured: DataFrame, modes: DataFrame) -> DataFrame:
    """How well an asset's measurements fit each failure mode of its class, best two.

    modes: (asset_type, mode, parameter, effect, direction, action).
    """
    seen = measured.where(F.col("limit_progress_pct").isNotNull())
    enough = seen.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*KEY)
    totals = modes.groupBy("asset_type", "mode").agg(F.sum(F.abs("effect")).alias("_total"))
    effects = modes.join(totals, ["asset_type", "mode"]).where("_total > 0")
    # The mode's own direction column stands for the measurement's.
    rows = seen.select(*KEY, "asset_type", "parameter", "limit_progress_pct").join(enough, KEY)
    joined = rows.join(effects, ["asset_type", "parameter"])
    sign = F.when((F.col("effect") > 0) == (F.col("direction") == "high"), 1.0).otherwise(-1.0)
    hit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("limit_progress_pct") * sign / FULL_PROGRESS))
    scored = joined.withColumn("_hit", hit).groupBy(*KEY, "mode").agg(
        (F.sum(F.abs("effect") * F.col("_hit")) / F.first("_total")).alias("match"),
        F.count_if(F.col("_hit") > SUPPORT).alias("supporting"),
        F.first("action").alias("mode_action"),
    )
    share = F.round("match", 9)
    fits = scored.where((share >= MATCH) & ((F.col("supporting") >= 2) | (share >= CLEAR_MATCH)))
    return top_per_group(fits, k=MODES_KEPT, group_by=KEY, order_by="-match,mode")


def signature_findings(matches: DataFrame) -> DataFrame:
    m = F.col("match")
    return _finding(
        matches, "signature", "engineering",
        F.concat(F.lit("measurements together fit "), F.col("mode"), F.lit(", match "), _pct(m * 100)),
        F.least(F.lit(34.0), 12.0 + m * 26.0), F.least(F.lit(0.85), 0.4 + m * 0.5),
        mode=F.col("mode"), action=F.col("mode_action"),
    )


def runtime_findings(used: DataFrame) -> DataFrame:
    u = F.col("hours_used_pct")
    due = _finding(
        used.where(u >= REPORTED_HOURS), "runtime", "policy",
        F.concat(F.col("task"), F.lit(": "), _pct(u), F.lit(" of its running hours are used")),
        F.when(u < 90, 6.0).when(u < 100, 16.0).otherwise(26.0), 0.9, action=F.col("task"),
    )
    lacking = used.where("unrecorded").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    unknown = _finding(
        lacking, "runtime", "policy",
        F.concat(F.col("_n"), F.lit(" tasks have no record, so their use is unknown")), 3.0, 0.5,
        action=F.lit("complete the maintenance record or confirm the work was done"),
    )
    return due.unionByName(unknown)


def calendar_findings(used: DataFrame) -> DataFrame:
    u = F.col("days_used_pct")
    return _finding(
        used.where(u >= REPORTED_DAYS), "calendar", "policy",
        F.concat(F.col("task"), F.lit(": "), _pct(u), F.lit(" of its days are used")),
        F.when(u < 100, 4.0).otherwise(12.0), 0.9, action=F.col("task"),
    )


def history_findings(known: DataFrame, matches: DataFrame, assets: DataFrame, failures: DataFrame) -> DataFrame:
    d = F.col("days_since_repair")
    again = _finding(
        known.where((d <= RECENT_REPAIR_DAYS) & F.col("trend_window_is_clean")), "history", "history",
        F.concat(F.lit("repaired "), d, F.lit(" days ago and deviating again")), 10.0, 0.65,
    )
    kinds = assets.select("asset_id", "asset_type")
    before = failures.join(kinds, "asset_id").groupBy(
        "asset_type", F.col("failure_mode").alias("mode")
    ).agg(F.count(F.lit(1)).alias("_seen"))
    alike = matches.join(kinds, "asset_id").join(before, ["asset_type", "mode"])
    seen = _finding(
        alike, "history", "history",
        F.concat(F.col("mode"), F.lit(" happened "), F.col("_seen"), F.lit(" times on this class")),
        F.least(F.lit(14.0), 4.0 + F.col("_seen") * 1.5), 0.6, mode=F.col("mode"),
    )
    return again.unionByName(seen)


def _readable(record: DataFrame, condition: str) -> bool:
    try:
        with null_on_failure(record.sparkSession):
            record.select(F.expr(f"({condition})").cast("boolean"))
    except AnalysisException:
        return False
    return True


def rule_findings(record: DataFrame, rules: DataFrame) -> DataFrame:
    """Engineering rules kept as rows: the small table becomes one array of conditions.

    A rule that cannot be analysed over the record, as one that reads a column it
    lacks, does not fire, nor does one whose condition is null or fails.
    """
    fired = []
    for r in rules.collect():
        condition = (r["when"] or "").strip()
        if not condition or not _readable(record, condition):
            continue
        scope = F.lit(True) if r["asset_type"] in (None, "*") else F.col("asset_type") == r["asset_type"]
        hit = F.coalesce(F.expr(f"({condition})").cast("boolean"), F.lit(False)) & scope
        fired.append(
            F.when(
                hit,
                F.struct(
                    F.lit(f"{r['name']}: {r['finding']}").alias("s"),
                    F.lit(float(r["weight"] or 0.0)).alias("w"),
                    F.lit(float(r["confidence"] or 0.7)).alias("c"),
                    F.lit(r["failure_mode"]).cast("string").alias("m"),
                    F.lit(r["recommended_action"]).cast("string").alias("a"),
                ),
            )
        )
    empty = F.lit(None).cast("struct<s:string,w:double,c:double,m:string,a:string>")
    with null_on_failure(record.sparkSession):
        each = record.select(*KEY, F.explode(F.array_compact(F.array(*(fired or [empty])))).alias("_f"))
    return _finding(
        each, "engineering", "engineering", F.col("_f.s"), F.col("_f.w"), F.col("_f.c"),
        mode=F.col("_f.m"), action=F.col("_f.a"),
    )


def quality_findings(measured: DataFrame, known: DataFrame) -> DataFrame:
    """Reasons for doubt, so their weights are negative."""
    q = F.col("quality_score")
    crossing = (F.col("status_rank") >= 1) | F.coalesce(
        F.col("deviation_pct") > NOTABLE_DEVIATION, F.lit(False)
    )
    poor = _finding(
        measured.where(q < TRUSTED_QUALITY), "quality", "quality",
        F.concat(F.col("parameter"), F.lit(" has a data quality of only "), F.format_string("%.0f", q)),
        F.when(crossing, F.lit(-26.0)).otherwise(F.lit(-6.0)), 0.8, parameter=F.col("parameter"),
        action=F.lit("check or replace the sensor, then judge again"),
    )
    young = _finding(
        known.where(F.col("observed_days") < COLD_START_DAYS), "quality", "quality",
        F.concat(F.lit("only "), F.col("observed_days"), F.lit(" days are on record")), -10.0, 0.9,
        action=F.lit("keep to the maker's intervals until more is known"),
    )
    return poor.unionByName(young)
