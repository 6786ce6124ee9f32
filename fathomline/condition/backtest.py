"""Decision policies replayed over the record and scored against what happened."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from fathomline.condition.assess import Fleet, assess
from fathomline.condition.views import whole_days
from fathomline.functions import values as V
from fathomline.operators.aggregate import confusion_rates
from fathomline.operators.joins import look_ahead, within_intervals

BASES = ("degradation", "failure_horizon")


def checkpoints(
    features: DataFrame, *, warmup_days: int = 30, step_days: int = 7, horizon_days: int = 14
) -> list[str]:
    """Evaluation dates: after the warm-up, and not so late that the horizon is unknown."""
    days = [r[0] for r in features.select("day").distinct().orderBy("day").limit(warmup_days + 1).collect()]
    last = features.agg(F.max("day")).first()[0]
    if not days:
        raise ValueError("the features hold no days")
    first = days[warmup_days] if len(days) > warmup_days else days[0]
    at, end = datetime.fromisoformat(first), datetime.fromisoformat(last) - timedelta(days=horizon_days)
    out = []
    while at <= end:
        out.append(at.strftime("%Y-%m-%d 00:00:00"))
        at += timedelta(days=step_days)
    return out


def judged(
    decisions: DataFrame, failures: DataFrame, truth: DataFrame, *, horizon_days: int = 14,
    basis: str = "degradation",
) -> DataFrame:
    """Decisions with the label they should have met."""
    V.one_of("label basis", basis, BASES)
    episodes = truth.where(V.moment(truth, "onset").isNotNull())
    # Labels belong to (asset, moment), so they are found once and not per policy.
    asked = decisions.select("asset_id", "as_of").distinct()
    labelled = within_intervals(
        asked, episodes, keys="asset_id", time="as_of", start="onset", end="repaired", output="degrading"
    )
    labelled = look_ahead(
        labelled, failures, keys="asset_id", time="as_of", event_time="failure_date",
        horizon_seconds=horizon_days * 86_400, output="_lead",
    )
    failing = F.col("_lead").isNotNull()
    worth = F.col("degrading") if basis == "degradation" else failing
    flagged = F.col("condition_required") if basis == "degradation" else F.col("maintenance_required")
    out = decisions.join(labelled, ["asset_id", "as_of"]).withColumns(
        {"failed_within_horizon": failing, "worth_flagging": worth, "flagged": flagged,
         "assessed_at": F.date_format("as_of", "yyyy-MM-dd")}
    )
    outcome = (
        F.when(flagged & worth, "tp").when(flagged, "fp").when(worth, "fn").otherwise("tn")
    )
    return out.withColumn("outcome", outcome).withColumn("lead_days", F.col("_lead") / 86_400.0).drop("_lead")


def scores(rows: DataFrame) -> DataFrame:
    """Rates per policy and date."""
    return confusion_rates(
        rows, actual="worth_flagging", predicted="flagged", group_by="policy,assessed_at"
    )


def totals(rows: DataFrame) -> DataFrame:
    return confusion_rates(rows, actual="worth_flagging", predicted="flagged", group_by="policy")


def episode_scores(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Per policy: assets with an episode, those ever caught, and how early the first catch was."""
    spans = truth.select(
        "asset_id", V.moment(truth, "onset").alias("_on"), V.moment(truth, "failure").alias("_fail")
    ).where("_on IS NOT NULL")
    all_ = spans.select("asset_id").distinct()
    first = rows.where("outcome = 'tp'").groupBy("policy", "asset_id").agg(F.min("as_of").alias("_first"))
    caught = first.join(all_, "asset_id")
    ahead = caught.join(spans, "asset_id").where(F.col("_fail") > F.col("_first")).groupBy(
        "policy", "asset_id"
    ).agg(F.min(whole_days(F.col("_fail"), F.col("_first"))).alias("_days"))
    whole = all_.agg(F.count(F.lit(1))).scalar()
    per = caught.join(ahead, ["policy", "asset_id"], "left").groupBy("policy").agg(
        F.count(F.lit(1)).alias("episodes_detected"), F.round(F.avg("_days"), 2).alias("mean_detection_lead_days")
    )
    return rows.select("policy").distinct().join(per, "policy", "left").select(
        "policy", whole.alias("episodes"),
        F.coalesce("episodes_detected", F.lit(0)).alias("episodes_detected"),
        F.round(F.coalesce(F.try_divide(F.coalesce("episodes_detected", F.lit(0)), whole), F.lit(0.0)), 4)
        .alias("episode_recall"),
        "mean_detection_lead_days",
    )


def backtest(
    fleet: Fleet, truth: DataFrame, *, moments: list, policies, horizon_days: int = 14,
    basis: str = "degradation", keep=None,
) -> DataFrame:
    """Judged decisions of every policy at every moment, from one plan."""
    done = assess(fleet, moments=moments, policies=policies, keep=keep)
    return judged(done.decisions, fleet.failures, truth, horizon_days=horizon_days, basis=basis)
