"""From findings to decisions, for every asset, moment and policy at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.condition import findings as N
from fathomline.condition import views as W
from fathomline.functions import values as V
from fathomline.models.matrix import risk_matrix
from fathomline.models.projection import project_fits
from fathomline.models.scorecard import scorecard
from fathomline.operators.joins import append
from fathomline.operators.rows import top_per_group
from fathomline.session import settle

KEY = W.KEY
# The analyzers in order, and which of them a policy consults.
ANALYZERS = ("threshold", "baseline", "trend", "statistical", "signature", "runtime", "calendar",
             "history", "engineering", "quality")
POLICIES = {
    "threshold_only": (("threshold",), 15.0),
    "threshold_and_policy": (("threshold", "runtime", "calendar"), 18.0),
    "statistical": (("threshold", "baseline", "trend", "statistical", "runtime", "calendar"), 40.0),
    "full": (ANALYZERS, 44.0),
    # No threshold of its own: it follows the asset's criticality.
    "full_risk_adjusted": (ANALYZERS, None),
}
BY_CRITICALITY = {"critical": 26.0, "high": 34.0, "medium": 44.0, "low": 56.0}
DEFAULT_THRESHOLD = 44.0
PRIORITY = {"CRITICAL": "IMMEDIATE", "HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW"}
# The risk grid, the health components and bands, the limits of trends.
RISK = {
    "likelihood": {"column": "concern", "levels": ["low", "medium", "high"], "bands": [30.0, 60.0],
                   "default": "low"},
    "consequence": {"column": "criticality", "levels": ["low", "medium", "high", "critical"],
                    "default": "medium"},
    "grid": [["LOW", "LOW", "MEDIUM", "HIGH"], ["LOW", "MEDIUM", "HIGH", "CRITICAL"],
             ["MEDIUM", "HIGH", "CRITICAL", "CRITICAL"]],
    "severity_order": ["LOW", "MEDIUM", "HIGH", "CRITICAL"],
}
HEALTH = [
    {"name": "margin", "column": "worst_limit_progress_pct", "weight": 3.0, "good": 0, "bad": 100},
    {"name": "baseline", "column": "worst_deviation_pct", "weight": 2.5, "good": 0, "bad": 45},
    {"name": "trend", "column": "worst_trend_slope_per_day", "weight": 2.5, "good": 0, "bad": 1.5,
     "missing": "neutral", "neutral_score": 75.0},
    {"name": "spread", "column": "variability_ratio", "weight": 1.0, "good": 1, "bad": 3},
    {"name": "interval", "column": "interval_usage_pct", "weight": 1.5, "good": 0, "bad": 120},
    {"name": "failures", "column": "recent_failure_score", "weight": 1.0, "good": 0, "bad": 100,
     "missing": "neutral", "neutral_score": 85.0},
    {"name": "data", "column": "min_quality_score", "weight": 1.5, "kind": "passthrough",
     "missing": "neutral", "neutral_score": 60.0},
]
HEALTH_BANDS = [
    {"upto": 30, "label": "CRITICAL"}, {"upto": 50, "label": "POOR"}, {"upto": 70, "label": "DEGRADED"},
    {"upto": 85, "label": "WATCH"}, {"label": "HEALTHY"},
]
HEALTH_COVERAGE = 0.33
TREND_LIMITS = [{"name": "warning", "value": 33.4}, {"name": "emergency", "value": 100.0}]
TREND_HORIZON, TREND_POINTS, TREND_FIT, TREND_LEAST = 180.0, 6, 0.3, 4
TRUSTED, CORROBORATED_MATCH = 60.0, 45.0


@dataclass
class Fleet:
    """The tables an assessment reads. `quality` may be missing."""

    features: DataFrame
    assets: DataFrame
    maintenance: DataFrame
    failures: DataFrame
    policies: DataFrame
    modes: DataFrame
    rules: DataFrame
    quality: DataFrame | None = None


@dataclass
class Assessment:
    findings: DataFrame
    record: DataFrame
    decisions: DataFrame


def assess(
    fleet: Fleet, *, moments: list, policies=tuple(POLICIES), parameters: list[str] | None = None,
    keep=None, blocks: bool | None = None,
) -> Assessment:
    """All assets at all moments under all policies; the moment is part of every key.

    `keep` is applied to tables that several later steps read (for example
    `settle`, to write them once); by default everything stays one lazy plan.
    """
    keep = keep or (lambda df: df)
    measured = keep(W.measurements(fleet.features, moments, fleet.quality, blocks=blocks))
    known = keep(W.facts(fleet.features, fleet.maintenance, moments))
    used = keep(W.intervals(known, fleet.assets, fleet.policies, fleet.maintenance, moments))
    matches = keep(N.signature_matches(measured, fleet.modes))
    record = W.records(measured, known, used, fleet.assets, matches)
    if parameters is None:
        parameters = [r[0] for r in measured.select("parameter").distinct().orderBy("parameter").collect()]
    record = keep(W.widened(record, measured, parameters))
    found = keep(append(
        N.threshold_findings(measured), N.baseline_findings(measured),
        N.trend_findings(measured, known), N.statistical_findings(measured, known),
        N.signature_findings(matches), N.runtime_findings(used), N.calendar_findings(used),
        N.history_findings(known, matches, fleet.assets, fleet.failures),
        N.rule_findings(record, fleet.rules), N.quality_findings(measured, known),
    ).withColumn("contribution", F.col("weight") * F.col("confidence")))
    health = scorecard(
        record, components=HEALTH, bands=HEALTH_BANDS, min_coverage=HEALTH_COVERAGE, output="health",
        include_components=False,
    )
    windows = maintenance_window(measured, used, known)
    decisions = decide(found, health, forced_action(measured, record), windows, policies)
    return Assessment(found, record, decisions)


def maintenance_decisions(
    features: DataFrame, assets: DataFrame, maintenance: DataFrame, failures: DataFrame, policies: DataFrame,
    modes: DataFrame, rules: DataFrame, quality: DataFrame | None = None, *, moments: list,
    under: list | None = None,
) -> DataFrame:
    """The decisions alone, for composed plans: `under` lists policies, all by default."""
    fleet = Fleet(features, assets, maintenance, failures, policies, modes, rules, quality)
    return assess(fleet, moments=moments, policies=tuple(under or POLICIES), keep=settle).decisions


def policy_table(df: DataFrame, policies=tuple(POLICIES)) -> DataFrame:
    """(policy, analyzer, threshold), exploded onto the findings by their analyzer."""
    for p in policies:
        V.one_of("policy", p, POLICIES)
    listed = {a: [p for p in policies if a in POLICIES[p][0]] for a in ANALYZERS}
    pairs = [x for a, ps in listed.items() if ps for x in (F.lit(a), F.array(*[F.lit(p) for p in ps]))]
    return df.withColumn("policy", F.explode(F.create_map(*pairs)[F.col("analyzer")]))


def _threshold(policies) -> Column:
    fixed = [x for p in policies if POLICIES[p][1] is not None
             for x in (F.lit(p), F.lit(POLICIES[p][1]))]
    by_kind = F.create_map(*[F.lit(x) for kv in BY_CRITICALITY.items() for x in kv])
    adjusted = F.coalesce(by_kind[F.col("criticality")], F.lit(DEFAULT_THRESHOLD))
    return F.coalesce(F.create_map(*fixed)[F.col("policy")], adjusted) if fixed else adjusted


def concern(found: DataFrame, policies=tuple(POLICIES)) -> DataFrame:
    """Summed contributions per asset, moment and policy, within 0 and 100."""
    each = policy_table(found, policies)
    c, w = F.col("contribution"), F.abs("weight")
    useful = F.col("action").isNotNull() & (c > 0)
    strongest = F.struct(F.round(c, 9), F.col("analyzer"), F.col("statement"))
    return each.groupBy(*KEY, "policy").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.sum(c))).alias("concern"),
        F.try_divide(F.sum(w * F.col("confidence")), F.sum(w)).alias("_sure"),
        F.max_by("action", F.when(useful, strongest)).alias("_action"),
        F.max_by("failure_mode", F.when(useful & F.col("failure_mode").isNotNull(), strongest)).alias("_mode"),
        F.max((F.col("analyzer") == "quality")).alias("_doubt"),
        F.count(F.lit(1)).alias("evidence_count"),
    )


def forced_action(measured: DataFrame, record: DataFrame) -> DataFrame:
    """Crossings that are reason enough alone: trusted, and corroborated unless emergency."""
    backed = (
        (F.col("deviating_measurements") >= 2) | (F.col("signature_match_pct") >= CORROBORATED_MATCH)
        | (F.col("measurement_count") < 3)
    )
    rows = measured.select(*KEY, "status_rank", "quality_score").join(
        record.select(*KEY, backed.alias("_backed")), KEY
    )
    trusted = F.col("quality_score").isNull() | (F.col("quality_score") >= TRUSTED)
    rank = F.col("status_rank")
    return rows.groupBy(*KEY).agg(
        F.max(trusted & ((rank >= 3) | ((rank >= 2) & F.col("_backed")))).alias("past_critical")
    )


def maintenance_window(measured: DataFrame, used: DataFrame, known: DataFrame) -> DataFrame:
    """The earlier of the fastest trend to a limit and the interval that runs out first."""
    lines = measured.where(F.col("line_n") >= TREND_LEAST).select(
        *KEY, "parameter", F.col("line_n").alias("_n"), F.col("line_sxx").alias("_sxx"),
        F.col("line_syy").alias("_syy"), F.col("line_sxy").alias("_sxy"),
        F.struct(F.col("limit_progress_pct").alias("_y"), F.to_timestamp("day").alias("_at")).alias("_last"),
    )
    answers = project_fits(
        lines, [*KEY, "parameter"], "limit_progress_pct", TREND_LIMITS, "rising", TREND_POINTS,
        TREND_FIT, TREND_HORIZON, 1.96,
    ).where(F.col("days_to_limit").isNotNull())
    soonest = answers.groupBy(*KEY).agg(
        F.min_by(
            F.struct("days_to_limit", "basis", "parameter", "projected_date", "projected_earliest", "projected_latest"),
            F.struct("days_to_limit", "parameter", "limit_value"),
        ).alias("t")
    )
    u = F.col("hours_used_pct")
    daily = F.greatest(F.lit(1.0), F.col("runtime_hours_7d") / 7)
    left = F.greatest(F.lit(0.0), F.col("interval_hours") * (100 - u) / 100) / daily
    policy = used.where(u >= N.REPORTED_HOURS).groupBy(*KEY).agg(
        F.min(left).alias("_left"), F.min_by("task", F.struct(left, F.col("task"))).alias("_task")
    )
    both = known.select(*KEY).join(soonest, KEY, "left").join(policy, KEY, "left")
    by_policy = F.col("_left").isNotNull() & (
        F.col("t").isNull() | (F.col("_left") < F.col("t.days_to_limit"))
    )
    basis = F.col("t.basis")
    today = F.date_format("as_of", "yyyy-MM-dd")

    def ahead(days: Column) -> Column:
        return F.date_format(
            F.timestamp_micros(F.unix_micros("as_of") + (days * F.lit(8.64e10)).cast("bigint")), "yyyy-MM-dd"
        )

    return both.select(
        *KEY,
        F.when(by_policy, ahead(F.col("_left") * 0.75)).when(basis == "calculated", today)
        .when(basis == "estimated", F.coalesce("t.projected_earliest", "t.projected_date")).alias("window_start"),
        F.when(by_policy, ahead(F.col("_left"))).when(basis == "calculated", today)
        .when(basis == "estimated", F.coalesce("t.projected_latest", "t.projected_date")).alias("window_end"),
        F.when(by_policy, F.lit("calculated")).otherwise(F.coalesce(basis, F.lit("unknown"))).alias("window_basis"),
        F.when(by_policy, F.concat(F.lit("interval of "), F.col("_task")))
        .when(basis.isNotNull(), F.concat(F.lit("trend of "), F.col("t.parameter")))
        .otherwise(F.lit("nothing moves to a limit and no interval is due")).alias("window_reason"),
    )


def decide(
    found: DataFrame, health: DataFrame, forced: DataFrame, windows: DataFrame, policies=tuple(POLICIES)
) -> DataFrame:
    """One row per asset, moment and policy."""
    base = health.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    joined = (
        base.join(concern(found, policies), [*KEY, "policy"], "left")
        .join(forced, KEY, "left").join(windows, KEY, "left")
        .withColumn("concern", F.coalesce("concern", F.lit(0.0)))
    )
    rated = risk_matrix(joined, output="risk_level", **RISK)
    over = F.col("concern") >= _threshold(policies)
    spent = F.coalesce(F.col("interval_usage_pct") >= 100, F.lit(False))
    past = F.coalesce("past_critical", F.lit(False))
    condition = over | past
    required = condition | spent
    serious = F.col("risk_level").isin("HIGH", "CRITICAL")
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    sure = F.coalesce("_sure", F.lit(0.4)) * (0.55 + 0.45 * F.col("health_coverage")) * N.quality_factor(
        F.col("min_quality_score")
    )
    return rated.select(
        *KEY, "policy", "asset_type", "criticality",
        required.alias("maintenance_required"),
        condition.alias("condition_required"),
        F.when(condition, "condition").when(spent, "policy").otherwise("none").alias("required_because"),
        F.when(~required, "NONE").when(past & serious, "IMMEDIATE")
        .otherwise(F.coalesce(ranks[F.col("risk_level")], F.lit("MEDIUM"))).alias("priority"),
        F.col("health").alias("health_score"),
        F.coalesce("health_band", F.lit("UNKNOWN")).alias("health_status"),
        F.round("health_coverage", 3).alias("health_coverage"),
        "risk_level", F.col("risk_level_likelihood").alias("likelihood"),
        F.round("concern", 2).alias("concern_score"),
        F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.97), sure)), 3).alias("confidence"),
        F.coalesce(
            "_action",
            F.when(required, "arrange an inspection")
            .when(F.coalesce("_doubt", F.lit(False)), "check the sensor first")
            .otherwise("keep to the maintenance plan"),
        ).alias("recommended_action"),
        F.col("_mode").alias("suspected_failure_mode"),
        "window_start", "window_end", "window_basis", "window_reason",
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.col("min_quality_score").alias("data_quality_score"),
        "observed_days", "interval_usage_pct", "runtime_hours_total",
    )


def top_reasons(found: DataFrame, policies=tuple(POLICIES), k: int = 3) -> DataFrame:
    """The strongest statements per asset, moment and policy, joined to one text."""
    each = policy_table(found, policies).where("contribution > 0")
    kept = top_per_group(
        each, k=k, group_by=[*KEY, "policy"], order_by="-contribution,analyzer,statement", output="place"
    )
    return kept.groupBy(*KEY, "policy").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "statement"))), lambda e: e["statement"]),
            " / ",
        ).alias("reasons")
    )


def evidence_rows(found: DataFrame, *, min_contribution: float = 0.0) -> DataFrame:
    """Findings strongest first, without those that hardly count."""
    return found.where(F.abs("contribution") >= min_contribution).orderBy(
        *KEY, F.abs("contribution").desc(), "analyzer", "statement"
    )


def fleet_summary(decisions: DataFrame) -> DataFrame:
    """Per moment and policy: counts by risk, health and priority, means, doubtful data."""
    def counts(column: str, values) -> list[Column]:
        return [F.count_if(F.col(column) == v).alias(f"{column}_{v.lower()}") for v in values]

    return decisions.groupBy("as_of", "policy").agg(
        F.count(F.lit(1)).alias("assets"),
        F.count_if("maintenance_required").alias("required"),
        *counts("risk_level", RISK["severity_order"]),
        *counts("health_status", ["HEALTHY", "WATCH", "DEGRADED", "POOR", "CRITICAL", "UNKNOWN"]),
        *counts("priority", ["NONE", "LOW", "MEDIUM", "HIGH", "IMMEDIATE"]),
        *counts("criticality", list(BY_CRITICALITY)),
        F.round(F.avg("health_score"), 2).alias("mean_health"),
        F.round(F.avg("concern_score"), 2).alias("mean_concern"),
        F.count_if(F.col("data_quality_score") < N.TRUSTED_QUALITY).alias("suspect_data"),
    )


def measurement_series(features: DataFrame, *, parameter: str, since=None, until=None) -> DataFrame:
    """One parameter's daily values with the limits that moved with its load."""
    rows = features.where(F.col("parameter") == parameter)
    if since:
        rows = rows.where(F.col("day") >= since)
    if until:
        rows = rows.where(F.col("day") <= until)
    return rows.select(
        "asset_id", "day", "value_mean", "value_max", "value_min", "expected", "warning_value",
        "critical_value", "emergency_value", "limit_progress_pct", "status",
    )


def timeline(maintenance: DataFrame, failures: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Repairs, failures and demanded work as one list of events."""
    parts = [
        maintenance.select(
            "asset_id", V.moment(maintenance, "maintenance_date").alias("at"),
            F.lit("maintenance").alias("kind"), F.col("maintenance_type").alias("what"),
            F.col("task").alias("detail"),
        ),
        failures.select(
            "asset_id", V.moment(failures, "failure_date").alias("at"), F.lit("failure").alias("kind"),
            F.col("failure_mode").alias("what"), V.col(failures, "severity").cast("string").alias("detail"),
        ),
    ]
    if decisions is not None:
        parts.append(
            decisions.where("maintenance_required").select(
                "asset_id", F.col("as_of").alias("at"), F.lit("assessment").alias("kind"),
                F.col("priority").alias("what"), F.col("recommended_action").alias("detail"),
            )
        )
    return append(*parts)

