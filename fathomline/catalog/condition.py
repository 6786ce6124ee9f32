"""Condition monitoring; a group of ten users is an asset and an event type its sensor."""

from pyspark.sql import functions as F

from fathomline.catalog.base import Catalog, table
from fathomline.catalog.decided import DECIDED, FOUND, JUDGED
from fathomline.condition import assess as A
from fathomline.condition import backtest as B
from fathomline.condition import features as X
from fathomline.condition import findings as N
from fathomline.condition import views as W
from fathomline.session import settle

C = Catalog()
TYPES = ("T0", "T1", "T2")
PARAMETERS = ("click", "error", "purchase", "signup", "view")
MOMENTS = ["2024-01-14 00:00:00", "2024-01-21 00:00:00", "2024-01-28 00:00:00"]
TEN_USERS = "floor(user_id / 10)"


def _hourly(s, d):
    return table(s, d, "events").select(
        "event_id", "event_type", "value", "ts", F.expr(TEN_USERS).alias("a"), F.date_trunc("hour", "ts").alias("timestamp")
    )


def telemetry(s, d):
    k = F.col("event_id") % 50
    return _hourly(s, d).select(
        "timestamp", F.concat(F.lit("A"), "a").alias("asset_id"), F.col("event_id").alias("sensor_id"),
        F.col("event_type").alias("parameter"), "value",
        F.when(F.col("event_type") == "error", "°C").otherwise("mm/s").alias("unit"),
        F.when(k == 0, "bad").when(k == 1, "no_data").otherwise("good").alias("quality"),
    )


def operating(s, d):
    h = F.hour("timestamp")
    return _hourly(s, d).select("a", "timestamp").distinct().select(
        "timestamp", F.concat(F.lit("A"), "a").alias("asset_id"),
        F.when(h == 3, "stopped").when(h == 4, "overload").otherwise("running").alias("operating_state"),
        (F.lit(40.0) + h).alias("load_pct"),
        ((F.unix_micros("timestamp") / 1e6 - 1704067200) / 3600 * 0.8 + 5000).alias("runtime_hours_total"),
        F.dayofmonth("timestamp").cast("long").alias("start_count_total"),
    )


def assets(s, d):
    a = F.col("a")
    kind = F.array(*[F.lit(c) for c in ("critical", "high", "medium", "low")])
    return _hourly(s, d).select("a").distinct().select(
        F.concat(F.lit("A"), "a").alias("asset_id"),
        F.concat(F.lit("T"), a % 3).alias("asset_type"), F.concat(F.lit("S"), a % 2).alias("site_id"),
        kind[(a % 4).cast("int")].alias("criticality"), F.lit(20000.0).alias("mtbf_hours"),
    )


def environment(s, d):
    h = F.hour("timestamp")
    return _hourly(s, d).select((F.col("a") % 2).alias("p"), "timestamp").distinct().select(
        "timestamp", F.concat(F.lit("S"), "p").alias("site_id"),
        (F.lit(20.0) + h / 2 + F.col("p")).alias("ambient_temperature_c"),
        (F.lit(50.0) + h).alias("relative_humidity_pct"),
    )


def response(s):
    return s.createDataFrame(
        [(t, p, 10.0 + 2 * i, 20.0, 0.5, "high", 1) for i, t in enumerate(TYPES) for p in PARAMETERS],
        "asset_type string, parameter string, intercept double, load_coefficient double, "
        "ambient_coefficient double, direction string, direction_sign int",
    )


def thresholds(s):
    return s.createDataFrame(
        [(t, p, 20.0, 45.0, 90.0, 30.0) for t in TYPES for p in PARAMETERS],
        "asset_type string, parameter string, warning_offset double, critical_offset double, "
        "emergency_offset double, reference_value double",
    )


def readings(s, d):
    return X.condition_readings(telemetry(s, d), operating(s, d), assets(s, d), environment(s, d))


def features(s, d):
    # One row per series and day: read by the check for hot series and by the trends, then by every step.
    daily = settle(X.daily_readings(readings(s, d)))
    return settle(X.trends(X.residuals(daily, response(s), thresholds(s))))


def _logs(s, d):
    """Maintenance done and failures seen."""
    e = _hourly(s, d).select(
        F.concat(F.lit("A"), "a").alias("asset_id"), "ts", "event_type", "value", "event_id"
    )
    fixed = F.col("event_type") == "purchase"
    maintenance = e.where((F.col("event_type").isin("purchase", "signup")) & (F.col("value") > 110)).select(
        "asset_id", F.col("ts").alias("maintenance_date"),
        F.when(fixed, "corrective").otherwise("preventive").alias("maintenance_type"),
        F.when(fixed, "repair").otherwise("oil").alias("task"),
        F.when(fixed, "fix").otherwise("lube").alias("action_kind"),
    )
    failures = e.where("event_type = 'error' AND value > 200").select(
        "asset_id", F.col("ts").alias("failure_date"),
        F.when(F.col("value") > 300, "bearing").otherwise("clog").alias("failure_mode"),
        F.lit("major").alias("severity"),
    )
    return maintenance, failures


def fleet(s, d):
    maintenance, failures = _logs(s, d)
    e = _hourly(s, d).withColumn("asset_id", F.concat(F.lit("A"), "a"))
    quality = e.groupBy("asset_id", F.col("event_type").alias("parameter")).agg(
        F.round(60.0 + F.avg("value") % 40, 2).alias("quality_score"), F.lit("").alias("issues")
    )
    policies = s.createDataFrame(
        [(f"P{t}{k}", t, task, kind, hours, days) for t in TYPES
         for k, (task, kind, hours, days) in enumerate((("oil", "lube", 300.0, 10.0), ("belt", "swap", 4000.0, 365.0)))],
        "policy_id string, asset_type string, task string, action_kind string, interval_hours double, interval_days double",
    )
    modes = s.createDataFrame(
        [(t, m, p, w, "high", act) for t in TYPES for m, act, effects in (
            ("bearing", "replace the bearing", (("click", 1.0), ("view", 0.6))),
            ("clog", "clean the filter", (("signup", 1.0), ("error", 0.5), ("purchase", -0.4))))
         for p, w in effects],
        "asset_type string, mode string, parameter string, effect double, direction string, action string",
    )
    rules = s.createDataFrame(
        [("R1", "*", "two together", "click_limit_progress_pct > 30 and view_limit_progress_pct > 30", "both rise", "bearing", 12.0, 0.8, "look at both"),
         ("R2", "T1", "hot", "temperature_headroom_pct < 40", "little headroom", None, 8.0, 0.7, "cool it"),
         ("R3", "*", "absent", "no_such_reading > 1", "never", None, 50.0, 0.9, "none")],
        "rule_id string, asset_type string, name string, when string, finding string, failure_mode string, "
        "weight double, confidence double, recommended_action string",
    )
    return A.Fleet(features(s, d), assets(s, d), maintenance, failures, policies, modes, rules, quality)


def truth(f):
    return f.failures.select(
        "asset_id", (F.col("failure_date") - F.expr("INTERVAL 4 DAYS")).alias("onset"),
        F.col("failure_date").alias("failure"), (F.col("failure_date") + F.expr("INTERVAL 1 DAY")).alias("repaired"),
    )


TELEMETRY = """ev AS (SELECT *, user_id // 10 AS a, date_trunc('hour', ts) AS h FROM events),
  tel AS (SELECT h, a, event_type AS parameter, value FROM ev
    QUALIFY row_number() OVER (PARTITION BY h, a, event_type ORDER BY event_id) = 1 AND event_id % 50 > 1 AND hour(h) <> 3),
  rd AS (SELECT *, 40.0 + hour(h) AS load_pct, 20.0 + hour(h) / 2 + a % 2 AS ambient, (epoch_us(h) / 1e6 - 1704067200) / 3600 * 0.8 + 5000 AS rt FROM tel)"""
FEATURES = TELEMETRY + """,
  dy AS (SELECT a, parameter, strftime(h, '%Y-%m-%d') AS day, count(*) AS sample_count, round(avg(value), 6) AS value_mean, max(value) AS value_max,
    min(value) AS value_min, round(stddev_samp(value), 6) AS value_std, round(avg(load_pct), 6) AS load_mean, round(avg(ambient), 6) AS ambient_mean,
    round(max(rt), 6) AS rt FROM rd GROUP BY ALL),
  rs AS (SELECT *, 10.0 + 2 * (a % 3) + 20.0 * load_mean / 100 + 0.5 * ambient_mean AS expected FROM dy),
  ft AS (SELECT *, value_mean - expected AS residual, 100 * (value_mean - expected) / (90.0 + 1e-6) AS progress,
    100 * (value_mean - expected) / (abs(expected) + 1e-6) AS deviation,
    CASE WHEN value_mean - expected >= 90 THEN 3 WHEN value_mean - expected >= 45 THEN 2 WHEN value_mean - expected >= 20 THEN 1 ELSE 0 END AS rank,
    CAST(day AS TIMESTAMP) AS t FROM rs)"""


@C.add("condition_readings", f"""WITH {TELEMETRY} SELECT concat('A', a) AS asset_id, parameter, strftime(h, '%Y-%m-%d %H') AS hour, value, CAST(load_pct AS DOUBLE) AS load_pct,
       CAST(ambient AS DOUBLE) AS ambient FROM rd""")
def _(s, d):
    return readings(s, d).select(
        "asset_id", "parameter", F.date_format("timestamp", "yyyy-MM-dd HH").alias("hour"), "value", "load_pct",
        F.col("ambient_temperature_c").alias("ambient"),
    )


@C.add("daily_readings", f"""WITH {FEATURES} SELECT concat('A', a) AS asset_id, parameter, day, sample_count, value_mean, value_max, value_min, value_std,
       load_mean AS load_pct_mean, ambient_mean AS ambient_temperature_c_mean FROM dy""")
def _(s, d):
    return X.daily_readings(readings(s, d)).select(
        "asset_id", "parameter", "day", "sample_count", "value_mean", "value_max", "value_min", "value_std",
        "load_pct_mean", "ambient_temperature_c_mean",
    )


@C.add("limit_progress", f"""WITH {FEATURES} SELECT concat('A', a) AS asset_id, parameter, day, round(expected, 6) AS expected, round(residual, 6) AS residual,
       round(progress, 6) AS limit_progress_pct, round(deviation, 6) AS deviation_pct, CAST(rank AS INTEGER) AS status_rank,
       ['normal', 'warning', 'critical', 'emergency'][rank + 1] AS status FROM ft""")
def _(s, d):
    out = X.residuals(X.daily_readings(readings(s, d)), response(s), thresholds(s))
    return out.select("asset_id", "parameter", "day", *[F.round(c, 6).alias(c) for c in (
        "expected", "residual", "limit_progress_pct", "deviation_pct")], "status_rank", "status")


def _over(n):
    return f"OVER (PARTITION BY a, parameter ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@C.add("rolling_features", f"""WITH {FEATURES}, x AS (SELECT *, epoch_us(t) / 8.64e10 AS x FROM ft)
       SELECT concat('A', a) AS asset_id, parameter, day, CASE WHEN count(*) {_over(7)} >= 3 THEN round(avg(residual) {_over(7)}, 6) END AS residual_roll_mean7,
         CASE WHEN count(*) {_over(7)} >= 3 THEN round(stddev_samp(residual) {_over(7)}, 6) END AS residual_roll_std7,
         CASE WHEN count(*) {_over(30)} >= 10 THEN round(stddev_samp(residual) {_over(30)}, 6) END AS residual_roll_std30,
         CASE WHEN count(*) {_over(21)} >= 6 THEN round((residual - avg(residual) {_over(21)}) / stddev_samp(residual) {_over(21)}, 6) END AS residual_roll_zscore21,
         CASE WHEN count(*) {_over(21)} >= 6 THEN round(regr_slope(progress, x) {_over(21)}, 6) END AS progress_roll_slope21,
         CASE WHEN count(*) {_over(21)} >= 6 THEN round(regr_r2(progress, x) {_over(21)}, 6) END AS progress_roll_r_squared21 FROM x""")
def _(s, d):
    return features(s, d).select(
        "asset_id", "parameter", "day", "residual_roll_mean7", "residual_roll_std7", "residual_roll_std30",
        "residual_roll_zscore21", "progress_roll_slope21", "progress_roll_r_squared21",
    )


@C.add("fleet_snapshot", f"""WITH {FEATURES} SELECT concat('A', a) AS asset_id, parameter, day, value_mean, CAST(rank AS INTEGER) AS status_rank FROM ft
       QUALIFY row_number() OVER (PARTITION BY a, parameter ORDER BY day DESC) = 1""")
def _(s, d):
    return X.fleet_snapshot(features(s, d)).select("asset_id", "parameter", "day", "value_mean", "status_rank")


_LISTED = f"""SELECT CAST(m AS TIMESTAMP) AS m FROM (VALUES {', '.join(f"('{m}')" for m in MOMENTS)}) v(m)"""
# The days that a backtest looks at: after ten days of warm-up, every fourth, five before the end at last.
_CHECKED = """SELECT unnest(generate_series(first, last - INTERVAL 5 DAYS, INTERVAL 4 DAYS)) AS m FROM (
    SELECT coalesce(min(t) FILTER (i = 11), min(t)) AS first, max(t) AS last FROM (SELECT t, dense_rank() OVER (ORDER BY t) AS i FROM ft))"""
_SEEN = """
  me AS (SELECT m, f.* FROM ft f JOIN mo ON f.t <= m QUALIFY row_number() OVER (PARTITION BY m, a, parameter ORDER BY t DESC) = 1),
  dq AS (SELECT user_id // 10 AS a, event_type AS parameter, round(60.0 + avg(value) % 40, 2) AS q FROM events GROUP BY ALL),
  mq AS (SELECT me.*, q, CASE WHEN q IS NULL THEN 0.85 ELSE greatest(0.3, least(1, q / 100)) END AS qf FROM me LEFT JOIN dq USING (a, parameter)),
  mt AS (SELECT user_id // 10 AS a, ts, CASE WHEN event_type = 'purchase' THEN 'repair' ELSE 'oil' END AS task FROM events
    WHERE event_type IN ('purchase', 'signup') AND value > 110),
  pd AS (SELECT m, a, t, max(rt) AS rt, arg_min(sample_count, parameter) AS s, min(parameter) AS p FROM ft JOIN mo ON t <= m GROUP BY ALL),
  pw AS (SELECT *, row_number() OVER (PARTITION BY m, a ORDER BY t DESC) AS i, count(*) OVER (PARTITION BY m, a) AS n, min(p) OVER (PARTITION BY m, a) AS p0 FROM pd),
  fa AS (SELECT m, a, count(*) AS days, max(rt) AS rt, CAST(coalesce(sum(s) FILTER (i <= least(7, n - 1) AND p = p0), 0) AS DOUBLE) AS week,
    (SELECT max(ts) FROM mt WHERE mt.a = pw.a AND task = 'repair' AND ts <= m) AS fixed FROM pw GROUP BY ALL),
  fk AS (SELECT *, CAST(floor((epoch_us(m) - epoch_us(fixed)) / 8.64e10) AS BIGINT) AS since FROM fa),
  iv AS (SELECT m, a, week, rt, c.task, hrs, dys, (SELECT max(ts) FROM mt WHERE mt.a = fk.a AND ts <= m AND (mt.task = c.task OR mt.task = 'repair')) AS last
    FROM fk, (VALUES ('oil', 300.0, 10.0), ('belt', 4000.0, 365.0)) c(task, hrs, dys)),
  iu AS (SELECT *, 100 * least(rt, greatest(0, (epoch_us(m) - epoch_us(last)) / 8.64e10) * greatest(1, CASE WHEN week > 0 THEN week / 7 ELSE 8 END)) / hrs AS hu,
    100 * floor((epoch_us(m) - epoch_us(last)) / 8.64e10) / dys AS du FROM iv)"""


def _at(moments):
    return f"{FEATURES},\n  mo AS ({moments}),{_SEEN}"


VIEW = _at(_LISTED)


def _named(columns):
    return f"concat('A', a) AS asset_id, strftime(m, '%Y-%m-%d') AS as_of, {columns}"


def _dated(df):
    return df.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


def _measured(s, d, f):
    return W.measurements(f.features, MOMENTS, f.quality)


@C.add("asset_facts", f"WITH {VIEW} SELECT {_named('days AS observed_days, round(rt, 4) AS runtime_hours_total, week AS runtime_hours_7d, since AS days_since_repair, since IS NULL OR since >= 21 AS trend_window_is_clean')} FROM fk")
def _(s, d):
    f = fleet(s, d)
    return _dated(W.facts(f.features, f.maintenance, MOMENTS)).select(
        "asset_id", "as_of", "observed_days", F.round("runtime_hours_total", 4).alias("runtime_hours_total"),
        "runtime_hours_7d", "days_since_repair", "trend_window_is_clean",
    )


@C.add("interval_use", f"WITH {VIEW} SELECT {_named('task, round(CASE WHEN last IS NOT NULL THEN hu END, 5) AS hours_used_pct, round(du, 5) AS days_used_pct, last IS NULL AS unrecorded')} FROM iu")
def _(s, d):
    f = fleet(s, d)
    known = W.facts(f.features, f.maintenance, MOMENTS)
    out = _dated(W.intervals(known, f.assets, f.policies, f.maintenance, MOMENTS))
    return out.select("asset_id", "as_of", "task", F.round("hours_used_pct", 5).alias("hours_used_pct"),
                      F.round("days_used_pct", 5).alias("days_used_pct"), "unrecorded")


def _found(df):
    return _dated(df).select(
        "asset_id", "as_of", "parameter", F.round("weight", 7).alias("weight"), F.round("confidence", 7).alias("confidence")
    )


@C.add("threshold_findings", f"WITH {VIEW} SELECT {_named('parameter, CASE rank WHEN 1 THEN 18.0::DOUBLE WHEN 2 THEN 34.0 ELSE 52.0 END AS weight, round(0.95 * qf, 7) AS confidence')} FROM mq WHERE rank >= 1")
def _(s, d):
    return _found(N.threshold_findings(_measured(s, d, fleet(s, d))))


@C.add("baseline_findings", f"WITH {VIEW} SELECT {_named('parameter, round(least(26, 3 + progress * 0.28), 7) AS weight, round(0.75 * qf, 7) AS confidence')} FROM mq WHERE progress >= 22")
def _(s, d):
    return _found(N.baseline_findings(_measured(s, d, fleet(s, d))))


@C.add("runtime_findings", f"""WITH {VIEW}, x AS (SELECT m, a, CASE WHEN hu < 90 THEN 6.0 WHEN hu < 100 THEN 16.0 ELSE 26.0 END AS w, 0.9 AS c FROM iu WHERE hu >= 70 AND last IS NOT NULL
       UNION ALL SELECT DISTINCT m, a, 3.0, 0.5 FROM iu WHERE last IS NULL) SELECT {_named('CAST(NULL AS VARCHAR) AS parameter, CAST(w AS DOUBLE) AS weight, CAST(c AS DOUBLE) AS confidence')} FROM x""")
def _(s, d):
    f = fleet(s, d)
    known = W.facts(f.features, f.maintenance, MOMENTS)
    return _found(N.runtime_findings(W.intervals(known, f.assets, f.policies, f.maintenance, MOMENTS)))


@C.add("calendar_findings", f"WITH {VIEW} SELECT {_named('CAST(NULL AS VARCHAR) AS parameter, CASE WHEN du < 100 THEN 4.0::DOUBLE ELSE 12.0 END AS weight, 0.9::DOUBLE AS confidence')} FROM iu WHERE du >= 80")
def _(s, d):
    f = fleet(s, d)
    known = W.facts(f.features, f.maintenance, MOMENTS)
    return _found(N.calendar_findings(W.intervals(known, f.assets, f.policies, f.maintenance, MOMENTS)))


@C.add("signature_matches", f"""WITH {VIEW}, ef AS (SELECT * FROM (VALUES ('bearing', 'click', 1.0, 1.6), ('bearing', 'view', 0.6, 1.6), ('clog', 'signup', 1.0, 1.9),
         ('clog', 'error', 0.5, 1.9), ('clog', 'purchase', -0.4, 1.9)) v(mode, parameter, effect, total)),
       h AS (SELECT m, a, mode, effect, total, greatest(0, least(1, progress * sign(effect) / 50)) AS hit FROM me JOIN ef USING (parameter)),
       k AS (SELECT m, a, mode, sum(abs(effect) * hit) / any_value(total) AS share, CAST(count_if(hit > 0.35) AS BIGINT) AS supporting FROM h GROUP BY ALL)
       SELECT {_named('mode, round(share, 6) AS "match", supporting')} FROM k WHERE share >= 0.45 AND (supporting >= 2 OR share >= 0.6)""")
def _(s, d):
    f = fleet(s, d)
    out = _dated(N.signature_matches(_measured(s, d, f), f.modes))
    return out.select("asset_id", "as_of", "mode", F.round("match", 6).alias("match"), "supporting")


@C.add("quality_findings", f"""WITH {VIEW}, x AS (SELECT m, a, parameter, CASE WHEN rank >= 1 OR deviation > 8 THEN -26.0 ELSE -6.0 END AS w, 0.8 AS c FROM mq WHERE q < 70
       UNION ALL SELECT m, a, NULL, -10.0, 0.9 FROM fk WHERE days < 14) SELECT {_named('parameter, CAST(w AS DOUBLE) AS weight, CAST(c AS DOUBLE) AS confidence')} FROM x""")
def _(s, d):
    f = fleet(s, d)
    return _found(N.quality_findings(_measured(s, d, f), W.facts(f.features, f.maintenance, MOMENTS)))


_ROLLED = f""",
  ro AS (SELECT a, parameter, t, CASE WHEN count(*) {_over(21)} >= 6 THEN round((residual - avg(residual) {_over(21)}) / stddev_samp(residual) {_over(21)}, 6) END AS z,
    CASE WHEN count(*) {_over(7)} >= 3 THEN round(stddev_samp(residual) {_over(7)}, 6) END AS s7,
    CASE WHEN count(*) {_over(30)} >= 10 THEN round(stddev_samp(residual) {_over(30)}, 6) END AS s30,
    CASE WHEN count(*) {_over(21)} >= 6 THEN round(regr_slope(progress, epoch_us(t) / 8.64e10) {_over(21)}, 6) END AS sl,
    CASE WHEN count(*) {_over(21)} >= 6 THEN round(regr_r2(progress, epoch_us(t) / 8.64e10) {_over(21)}, 6) END AS r2 FROM ft),
  mr AS (SELECT mq.*, z, s7, s30, sl, r2, since IS NULL OR since >= 21 AS clean, since FROM mq JOIN ro USING (a, parameter, t) JOIN fk USING (m, a))"""
_ROLL = VIEW + _ROLLED
_CHAIN = _ROLL + DECIDED
_REPLAY = _at(_CHECKED) + _ROLLED + JUDGED
_FINDING = """an AS analyzer, cat AS category, parameter, mode AS failure_mode, st AS statement, round(w, 7) AS weight, round(c, 7) AS confidence,
       act AS action, round(s, 7) AS contribution"""


@C.add("trend_findings", f"""WITH {_ROLL}, x AS (SELECT m, a, NULL AS parameter, -6.0 AS w, 0.85 AS c FROM fk WHERE since < 21
       UNION ALL SELECT m, a, parameter, CASE WHEN coalesce(r2 < 0.25, false) THEN 4.0 ELSE least(30, 6 + sl * 9) END,
         CASE WHEN coalesce(r2 < 0.25, false) THEN 0.4 ELSE least(0.9, 0.45 + coalesce(nullif(r2, 0), 0.5) * 0.5) * qf END FROM mr WHERE clean AND sl > 0.15)
       SELECT {_named('parameter, round(CAST(w AS DOUBLE), 7) AS weight, round(CAST(c AS DOUBLE), 7) AS confidence')} FROM x""")
def _(s, d):
    f = fleet(s, d)
    return _found(N.trend_findings(_measured(s, d, f), W.facts(f.features, f.maintenance, MOMENTS)))


@C.add("statistical_findings", f"""WITH {_ROLL}, x AS (SELECT m, a, parameter, least(20, 6 * abs(z) - 6) AS w, 0.7 * qf AS c FROM mr WHERE clean AND abs(z) >= 2
       UNION ALL SELECT m, a, parameter, least(16, 4 * s7 / s30), 0.6 * qf FROM mr WHERE clean AND s7 > 0 AND s30 > 1e-9 AND s7 / s30 >= 1.8)
       SELECT {_named('parameter, round(w, 7) AS weight, round(c, 7) AS confidence')} FROM x""")
def _(s, d):
    f = fleet(s, d)
    return _found(N.statistical_findings(_measured(s, d, f), W.facts(f.features, f.maintenance, MOMENTS)))


@C.add("asset_records", f"""WITH {_ROLL}, g AS (SELECT m, a, count(*) AS measurement_count, max(rank) AS max_threshold_rank, max(progress) AS worst, max(deviation) AS dev, max(sl) AS slope,
         CAST(count_if(progress >= 22) AS BIGINT) AS deviating_measurements, max(CASE WHEN s7 > 0 AND s30 > 1e-9 THEN s7 / s30 END) AS ratio,
         100 - max(CASE WHEN parameter = 'error' THEN progress END) AS headroom, min(q) AS min_quality_score FROM mr GROUP BY ALL),
       u AS (SELECT m, a, max(CASE WHEN last IS NOT NULL THEN hu END) AS hu, CAST(count_if(last IS NULL) AS BIGINT) AS unrecorded_intervals FROM iu GROUP BY ALL)
       SELECT {_named('''measurement_count, CAST(max_threshold_rank AS INTEGER) AS max_threshold_rank, round(worst, 5) AS worst_limit_progress_pct, round(dev, 5) AS worst_deviation_pct,
         slope AS worst_trend_slope_per_day, deviating_measurements, round(ratio, 5) AS variability_ratio, round(headroom, 2) AS temperature_headroom_pct, min_quality_score,
         round(hu, 2) AS interval_usage_pct, unrecorded_intervals, CASE WHEN since IS NULL THEN 0.0 ELSE round(greatest(0, 100 * (1 - since / greatest(30, 20000.0 / 24 * 0.05))), 2) END AS recent_failure_score''')}
       FROM g JOIN u USING (m, a) JOIN fk USING (m, a)""")
def _(s, d):
    f = fleet(s, d)
    measured = settle(_measured(s, d, f))
    known = settle(W.facts(f.features, f.maintenance, MOMENTS))
    used = W.intervals(known, f.assets, f.policies, f.maintenance, MOMENTS)
    out = W.records(measured, known, used, f.assets, N.signature_matches(measured, f.modes))
    return _dated(out).select(
        "asset_id", "as_of", "measurement_count", "max_threshold_rank",
        F.round("worst_limit_progress_pct", 5).alias("worst_limit_progress_pct"),
        F.round("worst_deviation_pct", 5).alias("worst_deviation_pct"), "worst_trend_slope_per_day",
        "deviating_measurements", F.round("variability_ratio", 5).alias("variability_ratio"),
        "temperature_headroom_pct", "min_quality_score", "interval_usage_pct", "unrecorded_intervals",
        "recent_failure_score",
    )


def _assessed(s, d, policies=tuple(A.POLICIES)):
    return A.assess(fleet(s, d), moments=MOMENTS, policies=policies, parameters=list(PARAMETERS), keep=settle)


def _rounded(df):
    """Weights, confidences and contributions to seven places, as sums differ in the last."""
    return _dated(df).withColumns({c: F.round(c, 7) for c in ("weight", "confidence", "contribution")})


@C.add("rule_findings", f"WITH {_ROLL}{FOUND} SELECT {_named(_FINDING)} FROM fi WHERE an = 'engineering'")
def _(s, d):
    done = _assessed(s, d)
    return _rounded(done.findings.where("analyzer = 'engineering'"))


@C.add("concern", f"""WITH {VIEW}, k AS (SELECT m, a, 'threshold' AS an, CASE rank WHEN 1 THEN 18.0 WHEN 2 THEN 34.0 ELSE 52.0 END * 0.95 * qf AS c FROM mq WHERE rank >= 1
       UNION ALL SELECT m, a, 'runtime', CASE WHEN hu < 90 THEN 6.0 WHEN hu < 100 THEN 16.0 ELSE 26.0 END * 0.9 FROM iu WHERE hu >= 70 AND last IS NOT NULL
       UNION ALL SELECT DISTINCT m, a, 'runtime', 3.0 * 0.5 FROM iu WHERE last IS NULL
       UNION ALL SELECT m, a, 'calendar', CASE WHEN du < 100 THEN 4.0 ELSE 12.0 END * 0.9 FROM iu WHERE du >= 80),
       p AS (SELECT *, 'threshold_and_policy' AS policy FROM k UNION ALL SELECT *, 'threshold_only' FROM k WHERE an = 'threshold')
       SELECT {_named('policy, round(greatest(0, least(100, sum(c))), 8) AS concern, count(*) AS evidence_count')} FROM p GROUP BY m, a, policy""")
def _(s, d):
    two = ("threshold_only", "threshold_and_policy")
    out = _dated(A.concern(_assessed(s, d, two).findings, two))
    return out.select("asset_id", "as_of", "policy", F.round("concern", 8).alias("concern"), "evidence_count")


@C.add("decisions", f"WITH {_CHAIN} SELECT {_named('* EXCLUDE (m, a)')} FROM dc")
def _(s, d):
    return _dated(_assessed(s, d).decisions)


@C.add("top_reasons", f"""WITH {_ROLL}{FOUND}, k AS (SELECT * FROM pf WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY m, a, policy ORDER BY s DESC, an, st) <= 3)
       SELECT {_named("policy, string_agg(st, ' / ' ORDER BY s DESC, an, st) AS reasons")} FROM k GROUP BY m, a, policy""")
def _(s, d):
    return _dated(A.top_reasons(_assessed(s, d).findings))


@C.add("evidence_rows", f"WITH {_ROLL}{FOUND} SELECT {_named(_FINDING)} FROM fi WHERE abs(s) >= 2")
def _(s, d):
    return _rounded(A.evidence_rows(_assessed(s, d).findings, min_contribution=2.0))


def _counts(column, levels):
    return ", ".join(f"CAST(count_if({column} = '{v}') AS BIGINT) AS {column}_{v.lower()}" for v in levels.split())


@C.add("fleet_summary", f"""WITH {_CHAIN} SELECT strftime(m, '%Y-%m-%d') AS as_of, policy, count(*) AS assets, CAST(count_if(maintenance_required) AS BIGINT) AS required,
       {_counts("risk_level", "LOW MEDIUM HIGH CRITICAL")}, {_counts("health_status", "HEALTHY WATCH DEGRADED POOR CRITICAL UNKNOWN")},
       {_counts("priority", "NONE LOW MEDIUM HIGH IMMEDIATE")}, {_counts("criticality", "critical high medium low")},
       round(avg(health_score), 2) AS mean_health, round(avg(concern_score), 2) AS mean_concern, CAST(count_if(data_quality_score < 70) AS BIGINT) AS suspect_data FROM dc GROUP BY m, policy""")
def _(s, d):
    return _dated(A.fleet_summary(_assessed(s, d).decisions))


@C.add("measurement_series", f"""WITH {FEATURES} SELECT concat('A', a) AS asset_id, day, value_mean, round(expected + 20, 6) AS warning_value,
       round(expected + 90, 6) AS emergency_value FROM ft WHERE parameter = 'click' AND day >= '2024-01-10'""")
def _(s, d):
    out = A.measurement_series(features(s, d), parameter="click", since="2024-01-10")
    return out.select("asset_id", "day", "value_mean", F.round("warning_value", 6).alias("warning_value"),
                      F.round("emergency_value", 6).alias("emergency_value"))


@C.add("timeline", """SELECT concat('A', user_id // 10) AS asset_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'maintenance' AS kind,
       CASE WHEN event_type = 'purchase' THEN 'corrective' ELSE 'preventive' END AS what, CASE WHEN event_type = 'purchase' THEN 'repair' ELSE 'oil' END AS detail
       FROM events WHERE event_type IN ('purchase', 'signup') AND value > 110
       UNION ALL SELECT concat('A', user_id // 10), strftime(ts, '%Y-%m-%d %H:%M:%S'), 'failure', CASE WHEN value > 300 THEN 'bearing' ELSE 'clog' END, 'major'
       FROM events WHERE event_type = 'error' AND value > 200""")
def _(s, d):
    return A.timeline(*_logs(s, d)).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


def _judged(s, d):
    f = fleet(s, d)
    moments = B.checkpoints(f.features, warmup_days=10, step_days=4, horizon_days=5)
    return f, settle(B.backtest(f, truth(f), moments=moments, policies=tuple(A.POLICIES), horizon_days=5, keep=settle))


@C.add("policy_backtest", f"""WITH {_REPLAY} SELECT policy, assessed_at, tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall,
       round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS specificity,
       round((tp + fp) / (tp + fp + fn + tn), 4) AS alert_rate FROM pr""")
def _(s, d):
    return B.scores(_judged(s, d)[1])


@C.add("policy_episodes", f"""WITH {_REPLAY} SELECT policy, (SELECT count(DISTINCT a) FROM fl) AS episodes, count(ca.a) AS episodes_detected,
       round(coalesce(count(ca.a) / nullif((SELECT count(DISTINCT a) FROM fl), 0), 0), 4) AS episode_recall, round(avg(lead), 2) AS mean_detection_lead_days
       FROM (SELECT DISTINCT policy FROM ju) LEFT JOIN ca USING (policy) GROUP BY policy""")
def _(s, d):
    f, rows = _judged(s, d)
    return B.episode_scores(rows, truth(f))
