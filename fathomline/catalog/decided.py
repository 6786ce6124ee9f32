"""SQL of the decision chain: findings, concern, health, windows and decisions, on top of the views of `condition`."""

from fathomline.condition.assess import POLICIES

_WITHIN = "OVER (PARTITION BY a, parameter ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"


def _pct(x):
    return f"concat(CAST(round({x}) AS BIGINT), '%')"


def _fixed(x, places):
    """As printed with so many places; what it prints was rounded to six."""
    return f"CAST(CAST(CAST({x} AS DECIMAL(18, 6)) AS DECIMAL(18, {places})) AS VARCHAR)"


def _after(at, days):
    """The day that many days behind a moment."""
    return f"strftime(make_timestamp(epoch_us({at}) + CAST(trunc({days} * 8.64e10) AS BIGINT)), '%Y-%m-%d')"


FOUND = f""",
  sg AS (SELECT * FROM (SELECT m, a, mode, sum(abs(effect) * hit) / any_value(total) AS k, count_if(hit > 0.35) AS supporting FROM (
      SELECT m, a, mode, effect, total, greatest(0, least(1, progress * sign(effect) / 50)) AS hit
      FROM me JOIN (SELECT m, a FROM me GROUP BY ALL HAVING count(*) >= 2) USING (m, a) JOIN (VALUES ('bearing', 'click', 1.0, 1.6), ('bearing', 'view', 0.6, 1.6),
        ('clog', 'signup', 1.0, 1.9), ('clog', 'error', 0.5, 1.9), ('clog', 'purchase', -0.4, 1.9)) v(mode, parameter, effect, total) USING (parameter)) GROUP BY ALL)
    WHERE round(k, 9) >= 0.45 AND (supporting >= 2 OR round(k, 9) >= 0.6)),
  fl AS (SELECT user_id // 10 AS a, ts, CASE WHEN value > 300 THEN 'bearing' ELSE 'clog' END AS mode FROM events WHERE event_type = 'error' AND value > 200),
  fs AS (SELECT a % 3 AS kind, mode, count(*) AS n FROM fl GROUP BY ALL),
  ck AS (SELECT m, a, max(progress) FILTER (parameter = 'click') AS pc, max(progress) FILTER (parameter = 'view') AS pv,
    round(100 - max(progress) FILTER (parameter = 'error'), 2) AS headroom FROM mq GROUP BY ALL),
  fi AS (SELECT *, w * c AS s FROM (
    SELECT m, a, 'threshold' AS an, 'threshold' AS cat, parameter, CAST(NULL AS VARCHAR) AS mode,
      concat(parameter, ' is at its ', ['warning', 'critical', 'emergency'][rank], ' limit') AS st, CASE rank WHEN 1 THEN 18.0::DOUBLE WHEN 2 THEN 34.0 ELSE 52.0 END AS w,
      CAST(0.95 * qf AS DOUBLE) AS c, concat('check ', parameter, ' against its limit') AS act FROM mq WHERE rank >= 1
    UNION ALL SELECT m, a, 'baseline', 'baseline', parameter, NULL, concat(parameter, ' has gone ', {_pct('progress')}, ' of the way to its emergency limit'),
      least(26, 3 + progress * 0.28), 0.75 * qf, NULL FROM mq WHERE progress >= 22
    UNION ALL SELECT m, a, 'quality', 'quality', NULL, NULL, concat('repaired ', since, ' days ago, inside the 21-day trend window'), -6.0, 0.85,
      'judge again once the window is past the repair' FROM fk WHERE since < 21
    UNION ALL SELECT m, a, 'trend', 'trend', parameter, NULL, CASE WHEN coalesce(r2 < 0.25, false) THEN concat(parameter, ' rises on average, but within its noise')
        ELSE concat(parameter, ' moves ', {_fixed('sl', 2)}, '% a day to its limit, about ', CAST(round(greatest(0, (100 - progress) / sl)) AS BIGINT), ' days off') END,
      CASE WHEN coalesce(r2 < 0.25, false) THEN 4.0 ELSE least(30, 6 + sl * 9) END,
      CASE WHEN coalesce(r2 < 0.25, false) THEN 0.4 ELSE least(0.9, 0.45 + coalesce(nullif(r2, 0), 0.5) * 0.5) * qf END, NULL FROM mr WHERE clean AND sl > 0.15
    UNION ALL SELECT m, a, 'statistical', 'statistical', parameter, NULL, concat(parameter, ' is ', CASE WHEN z > 0 THEN '+' ELSE '' END, {_fixed('z', 1)}, ' deviations from its own mean'),
      least(20, 6 * abs(z) - 6), 0.7 * qf, NULL FROM mr WHERE clean AND abs(z) >= 2
    UNION ALL SELECT m, a, 'statistical', 'statistical', parameter, NULL, concat(parameter, ' varies ', CAST(CAST(s7 / s30 AS DECIMAL(18, 1)) AS VARCHAR), ' times as much as usual'),
      least(16, 4 * s7 / s30), 0.6 * qf, NULL FROM mr WHERE clean AND s7 > 0 AND s30 > 1e-9 AND s7 / s30 >= 1.8
    UNION ALL SELECT m, a, 'signature', 'engineering', NULL, mode, concat('measurements together fit ', mode, ', match ', {_pct('k * 100')}), least(34, 12 + k * 26), least(0.85, 0.4 + k * 0.5),
      CASE mode WHEN 'bearing' THEN 'replace the bearing' ELSE 'clean the filter' END FROM sg
    UNION ALL SELECT m, a, 'runtime', 'policy', NULL, NULL, concat(task, ': ', {_pct('hu')}, ' of its running hours are used'),
      CASE WHEN hu < 90 THEN 6.0 WHEN hu < 100 THEN 16.0 ELSE 26.0 END, 0.9, task FROM iu WHERE hu >= 70 AND last IS NOT NULL
    UNION ALL SELECT m, a, 'runtime', 'policy', NULL, NULL, concat(count(*), ' tasks have no record, so their use is unknown'), 3.0, 0.5,
      'complete the maintenance record or confirm the work was done' FROM iu WHERE last IS NULL GROUP BY m, a
    UNION ALL SELECT m, a, 'calendar', 'policy', NULL, NULL, concat(task, ': ', {_pct('du')}, ' of its days are used'), CASE WHEN du < 100 THEN 4.0 ELSE 12.0 END, 0.9, task FROM iu WHERE du >= 80
    UNION ALL SELECT m, a, 'history', 'history', NULL, NULL, concat('repaired ', since, ' days ago and deviating again'), 10.0, 0.65, NULL FROM fk WHERE since BETWEEN 21 AND 45
    UNION ALL SELECT m, a, 'history', 'history', NULL, mode, concat(mode, ' happened ', n, ' times on this class'), least(14, 4 + n * 1.5), 0.6, NULL
      FROM sg JOIN fs USING (mode) WHERE kind = a % 3
    UNION ALL SELECT m, a, 'engineering', 'engineering', NULL, 'bearing', 'two together: both rise', 12.0, 0.8, 'look at both' FROM ck WHERE pc > 30 AND pv > 30
    UNION ALL SELECT m, a, 'engineering', 'engineering', NULL, NULL, 'hot: little headroom', 8.0, 0.7, 'cool it' FROM ck WHERE a % 3 = 1 AND headroom < 40
    UNION ALL SELECT m, a, 'quality', 'quality', parameter, NULL, concat(parameter, ' has a data quality of only ', CAST(round(q) AS BIGINT)),
      CASE WHEN rank >= 1 OR deviation > 8 THEN -26.0 ELSE -6.0 END, 0.8, 'check or replace the sensor, then judge again' FROM mq WHERE q < 70
    UNION ALL SELECT m, a, 'quality', 'quality', NULL, NULL, concat('only ', days, ' days are on record'), -10.0, 0.9,
      'keep to the maker''s intervals until more is known' FROM fk WHERE days < 14)),
  po AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{a}')" for p, (listed, _) in POLICIES.items() for a in listed)}) v(policy, an)),
  pf AS (SELECT * FROM fi JOIN po USING (an))"""

_FIRST = "ORDER BY round(s, 9) DESC, an DESC, st DESC"
_STRONG = "n >= 6 AND r2 >= 0.3"

DECIDED = FOUND + f""",
  cn AS (SELECT m, a, policy, greatest(0, least(100, sum(s))) AS concern, CASE WHEN sum(abs(w)) > 0 THEN sum(abs(w) * c) / sum(abs(w)) END AS sure,
    first(act {_FIRST}) FILTER (act IS NOT NULL AND s > 0) AS act, first(mode {_FIRST}) FILTER (act IS NOT NULL AND s > 0 AND mode IS NOT NULL) AS mode,
    bool_or(an = 'quality') AS doubt, count(*) AS evidence FROM pf GROUP BY m, a, policy),
  rc AS (SELECT m, a, count(*) AS measures, max(progress) AS worst, max(deviation) AS dev, max(sl) AS slope, count_if(progress >= 22) AS deviating,
    max(CASE WHEN s7 > 0 AND s30 > 1e-9 THEN s7 / s30 END) AS ratio, min(q) AS quality FROM mr GROUP BY m, a),
  us AS (SELECT m, a, round(max(CASE WHEN last IS NOT NULL THEN hu END), 2) AS used FROM iu GROUP BY m, a),
  re AS (SELECT rc.*, used, days, rt, CASE WHEN since IS NULL THEN 0.0 ELSE round(greatest(0, 100 * (1 - since / greatest(30, 20000.0 / 24 * 0.05))), 2) END AS failed,
    coalesce((SELECT round(100 * max(k), 2) FROM sg WHERE sg.m = rc.m AND sg.a = rc.a), 0) AS matched FROM rc JOIN us USING (m, a) JOIN fk USING (m, a)),
  hp AS (SELECT *, 10.5 + CASE WHEN ratio IS NULL THEN 0 ELSE 1 END + CASE WHEN used IS NULL THEN 0 ELSE 1.5 END AS weights,
    3 * greatest(0, least(100, 100 * (1 - worst / 100))) + 2.5 * greatest(0, least(100, 100 * (1 - dev / 45)))
    + 2.5 * coalesce(greatest(0, least(100, 100 * (1 - nullif(slope, 'nan') / 1.5))), 75) + coalesce(CASE WHEN ratio IS NOT NULL THEN greatest(0, least(100, 100 * (1 - (ratio - 1) / 2))) END, 0)
    + 1.5 * coalesce(CASE WHEN used IS NOT NULL THEN greatest(0, least(100, 100 * (1 - used / 120))) END, 0) + greatest(0, least(100, 100 * (1 - failed / 100)))
    + 1.5 * coalesce(quality, 60) AS points FROM re),
  hl AS (SELECT *, points / weights AS health, CAST(round(weights / 13, 4) AS DOUBLE) AS coverage FROM hp),
  fo AS (SELECT m, a, bool_or((q IS NULL OR q >= 60) AND (rank >= 3 OR (rank >= 2 AND (deviating >= 2 OR matched >= 45 OR measures < 3)))) AS past FROM mq JOIN re USING (m, a) GROUP BY m, a),
  ln AS (SELECT a, parameter, t, regr_count(progress, x) {_WITHIN} AS n, regr_sxx(progress, x) {_WITHIN} AS sxx, regr_syy(progress, x) {_WITHIN} AS syy,
    regr_sxy(progress, x) {_WITHIN} AS sxy FROM (SELECT *, epoch_us(t) / 8.64e10 AS x FROM ft)),
  lb AS (SELECT m, a, parameter, t, progress AS y, n, sxx, syy, CASE WHEN sxx > 0 THEN sxy / sxx END AS b, CASE WHEN sxx > 0 THEN greatest(0, syy - sxy * sxy / sxx) END AS res
    FROM me JOIN ln USING (a, parameter, t) WHERE n >= 4),
  lg AS (SELECT *, CASE WHEN syy > 0 THEN greatest(0, 1 - res / syy) END AS r2, sqrt(res / (n - 2) / sxx) AS se, y >= goal AS beyond,
    CASE WHEN y < goal AND b > 0 THEN (goal - y) / b END AS ahead FROM lb, (VALUES (33.4::DOUBLE), (100.0)) g(goal)),
  lp AS (SELECT *, CASE WHEN beyond THEN 0.0 WHEN ahead <= 180 THEN round(ahead, 2) END AS due, CASE WHEN beyond THEN 'calculated' WHEN ahead <= 180 AND {_STRONG} THEN 'estimated' ELSE 'inferred' END AS basis,
    CASE WHEN se = 0 OR b + 1.96 * se <= 0 THEN ahead ELSE (goal - y) / (b + 1.96 * se) END AS early,
    CASE WHEN se = 0 THEN ahead WHEN b - 1.96 * se > 0 AND (goal - y) / (b - 1.96 * se) <= 180 THEN (goal - y) / (b - 1.96 * se) ELSE ahead END AS late FROM lg),
  ls AS (SELECT * FROM lp WHERE due IS NOT NULL QUALIFY row_number() OVER (PARTITION BY m, a ORDER BY due, parameter, goal) = 1),
  pl AS (SELECT m, a, task, greatest(0, hrs * (100 - hu) / 100) / greatest(1, week / 7) AS room FROM iu WHERE hu >= 70 AND last IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY m, a ORDER BY room, task) = 1),
  wi AS (SELECT fk.m, fk.a, pl.task, room, basis, parameter, t, early, late, coalesce(room IS NOT NULL AND (due IS NULL OR room < due), false) AS bound
    FROM fk LEFT JOIN ls USING (m, a) LEFT JOIN pl USING (m, a)),
  ww AS (SELECT m, a,
    CASE WHEN bound THEN {_after('m', '(room * 0.75)')} WHEN basis = 'calculated' THEN strftime(m, '%Y-%m-%d') WHEN basis = 'estimated' THEN {_after('t', 'early')} END AS window_start,
    CASE WHEN bound THEN {_after('m', 'room')} WHEN basis = 'calculated' THEN strftime(m, '%Y-%m-%d') WHEN basis = 'estimated' THEN {_after('t', 'late')} END AS window_end,
    CASE WHEN bound THEN 'calculated' ELSE coalesce(basis, 'unknown') END AS window_basis,
    CASE WHEN bound THEN concat('interval of ', task) WHEN basis IS NOT NULL THEN concat('trend of ', parameter) ELSE 'nothing moves to a limit and no interval is due' END AS window_reason FROM wi),
  bl AS (SELECT * FROM (VALUES {', '.join(f"('{p}', CAST({'NULL' if level is None else level} AS DOUBLE))" for p, (_, level) in POLICIES.items())}) v(policy, level)),
  jo AS (SELECT hl.*, bl.policy, ['critical', 'high', 'medium', 'low'][a % 4 + 1] AS criticality, coalesce(level, [26.0, 34.0, 44.0, 56.0][a % 4 + 1]) AS level, coalesce(concern, 0) AS concern,
    sure, act, mode, coalesce(doubt, false) AS doubt, coalesce(evidence, 0) AS evidence, coalesce(past, false) AS past, coalesce(used >= 100, false) AS spent,
    window_start, window_end, window_basis, window_reason FROM hl CROSS JOIN bl LEFT JOIN cn USING (m, a, policy) LEFT JOIN fo USING (m, a) LEFT JOIN ww USING (m, a)),
  ri AS (SELECT *, CASE WHEN concern <= 30 THEN 1 WHEN concern <= 60 THEN 2 ELSE 3 END AS li, 4 - a % 4 AS co, concern >= level OR past AS cond FROM jo),
  dc AS (SELECT m, a, policy, concat('T', a % 3) AS asset_type, criticality, cond OR spent AS maintenance_required, cond AS condition_required,
    CASE WHEN cond THEN 'condition' WHEN spent THEN 'policy' ELSE 'none' END AS required_because,
    [['LOW', 'LOW', 'MEDIUM', 'HIGH'], ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], ['MEDIUM', 'HIGH', 'CRITICAL', 'CRITICAL']][li][co] AS risk_level,
    CASE WHEN NOT (cond OR spent) THEN 'NONE' WHEN past AND risk_level IN ('HIGH', 'CRITICAL') THEN 'IMMEDIATE' ELSE CASE risk_level WHEN 'CRITICAL' THEN 'IMMEDIATE' ELSE risk_level END END AS priority,
    round(health, 2) AS health_score, CASE WHEN health <= 30 THEN 'CRITICAL' WHEN health <= 50 THEN 'POOR' WHEN health <= 70 THEN 'DEGRADED' WHEN health <= 85 THEN 'WATCH' ELSE 'HEALTHY' END AS health_status,
    round(coverage, 3) AS health_coverage, ['low', 'medium', 'high'][li] AS likelihood, CAST(round(concern, 2) AS DOUBLE) AS concern_score,
    round(greatest(0.1, least(0.97, coalesce(sure, 0.4) * (0.55 + 0.45 * coverage) * CASE WHEN quality IS NULL THEN 0.85 ELSE greatest(0.3, least(1, quality / 100)) END)), 3) AS confidence,
    coalesce(act, CASE WHEN cond OR spent THEN 'arrange an inspection' WHEN doubt THEN 'check the sensor first' ELSE 'keep to the maintenance plan' END) AS recommended_action,
    mode AS suspected_failure_mode, window_start, window_end, window_basis, window_reason, evidence AS evidence_count, quality AS data_quality_score, days AS observed_days,
    used AS interval_usage_pct, rt AS runtime_hours_total FROM ri)"""

JUDGED = DECIDED + """,
  ju AS (SELECT m, a, policy, condition_required AS flagged, EXISTS (SELECT 1 FROM fl WHERE fl.a = dc.a AND ts - INTERVAL 4 DAYS <= m AND m < ts + INTERVAL 1 DAY) AS worth FROM dc),
  sc AS (SELECT policy, strftime(m, '%Y-%m-%d') AS assessed_at, CAST(count_if(flagged AND worth) AS BIGINT) AS tp, CAST(count_if(flagged AND NOT worth) AS BIGINT) AS fp,
    CAST(count_if(NOT flagged AND worth) AS BIGINT) AS fn, CAST(count_if(NOT flagged AND NOT worth) AS BIGINT) AS tn FROM ju GROUP BY ALL),
  pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM sc),
  ca AS (SELECT policy, a, min(m) AS seen, (SELECT min(floor((epoch_us(ts) - epoch_us(min(ju.m))) / 8.64e10)) FROM fl WHERE fl.a = ju.a AND fl.ts > min(ju.m)) AS lead
    FROM ju WHERE flagged AND worth GROUP BY policy, a)"""
