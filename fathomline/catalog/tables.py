"""Joins, aggregations, windows, reshaping and chart queries."""

from pyspark.sql import functions as F

from fathomline.catalog.base import Catalog, table
from fathomline.catalog.rows import PLACES, UNIQUE, hav_sql, places
from fathomline.functions import values as V
from fathomline.operators import aggregate as A
from fathomline.operators import charts as K
from fathomline.operators import joins as J
from fathomline.operators import reshape as S
from fathomline.operators import rows as R
from fathomline.operators import windows as W

C = Catalog()


@C.add(
    "segment_revenue",
    """SELECT c_mktsegment, count(*) AS row_count, round(sum(o_totalprice * 0.9), 2) AS net_sum,
       round(median(o_totalprice), 4) AS o_totalprice_median
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'
       GROUP BY c_mktsegment ORDER BY c_mktsegment""",
)
def _(s, d):
    """The first slice, as composed steps."""
    from fathomline.plans.compose import run_plan

    orders = table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = run_plan(
        [
            {"name": "joined", "use": "join", "inputs": {"right": "customer"},
             "options": {"on": ["c_custkey"], "columns": ["c_mktsegment"]}},
            {"name": "open", "use": "filter_rows",
             "options": {"column": "o_orderstatus", "op": "not_equals", "value": "F"}},
            {"name": "priced", "use": "formula",
             "options": {"expressions": {"net": "o_totalprice * 0.9"}}},
            {"name": "summed", "use": "summarise",
             "options": {"group_by": ["c_mktsegment"],
                         "measures": {"net": "sum", "o_totalprice": "median"}}},
            {"name": "sorted", "use": "sort_rows", "options": {"column": "c_mktsegment"}},
        ],
        orders,
        tables={"customer": table(s, d, "customer")},
    )["sorted"]
    return out.withColumn("net_sum", F.round("net_sum", 2)).withColumn(
        "o_totalprice_median", F.round("o_totalprice_median", 4)
    )


# ---------------------------------------------------------------- joins
def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), "o_totalprice")


def _rich(s, d):
    """A customer side that misses keys and clashes with a column name."""
    return table(s, d, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("key"), "c_name", F.col("c_acctbal").alias("o_totalprice")
    )


_RICH = "(SELECT c_custkey AS key, c_name, c_acctbal AS bal FROM customer WHERE c_acctbal > 0)"


@C.add(
    "join_inner",
    f"""SELECT o_orderkey, o_custkey AS key, o_totalprice, bal AS o_totalprice_right, c_name
       FROM orders JOIN {_RICH} c ON o_custkey = c.key""",
)
def _(s, d):
    return J.join(_orders(s, d), _rich(s, d), on="key")


@C.add(
    "join_left",
    f"""SELECT o_orderkey, o_custkey AS key, o_totalprice, c_name
       FROM orders LEFT JOIN {_RICH} c ON o_custkey = c.key""",
)
def _(s, d):
    return J.join(_orders(s, d), _rich(s, d), on="key", how="left", columns="c_name")


@C.add(
    "join_full",
    f"""SELECT o_orderkey, coalesce(o.key, c.key) AS key, o_totalprice, c_name
       FROM (SELECT o_orderkey, o_custkey AS key, o_totalprice FROM orders) o
       FULL JOIN {_RICH} c ON o.key = c.key""",
)
def _(s, d):
    return J.join(
        _orders(s, d), _rich(s, d), on="key", how="full",
        columns="c_name",
    )


@C.add(
    "join_key_types",
    """SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, n_name FROM supplier
       JOIN nation ON s_nationkey = n_nationkey""",
)
def _(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), "n_name")
    sup = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return J.join(sup, n, on="nation")


@C.add(
    "join_metrics",
    f"""SELECT (SELECT count(*) FROM orders) AS rows_left, (SELECT count(*) FROM {_RICH}) AS rows_right,
       (SELECT count(*) FROM orders LEFT JOIN {_RICH} c ON o_custkey = c.key) AS rows_out,
       (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT key FROM {_RICH})) AS unmatched_left""",
)
def _(s, d):
    return J.join_metrics(_orders(s, d), _rich(s, d), on="key", how="left")


MOMENTS = ["2024-01-05 00:00:00", "2024-01-15 12:00:00", "2024-01-29 00:00:00"]


@C.add(
    "as_of",
    f"""SELECT strftime(m, '%Y-%m-%d %H:%M:%S') AS as_of, user_id, event_type, event_id, value
       FROM events, (VALUES {', '.join(f"(TIMESTAMP '{m}')" for m in MOMENTS)}) q(m) WHERE ts <= m
       QUALIFY row_number() OVER (PARTITION BY m, user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(s, d):
    e = table(s, d, "events").drop("props")
    out = J.as_of(e, keys="user_id,event_type", time="ts", moments=MOMENTS, tie_break="event_id")
    return out.select(
        F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), "user_id", "event_type",
        "event_id", "value",
    )


@C.add(
    "as_of_one",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-01'
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(s, d):
    return J.as_of_one(
        table(s, d, "orders"), keys="o_custkey", time="o_orderdate", moment="1998-06-01",
        tie_break="o_orderkey",
    ).select("o_custkey", "o_orderkey")


def spells(s, d):
    """From each purchase to two days later; every seventh stays open."""
    return table(s, d, "events").where("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("onset"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("repaired"),
    )


SPELLS = """(SELECT user_id, ts AS onset, CASE WHEN event_id % 7 <> 0 THEN ts + INTERVAL 2 DAY END
    AS repaired FROM events WHERE event_type = 'purchase')"""


@C.add(
    "within_intervals",
    f"""SELECT event_id, user_id, EXISTS (SELECT 1 FROM {SPELLS} i WHERE i.user_id = e.user_id
       AND e.ts >= i.onset AND (i.repaired IS NULL OR e.ts < i.repaired)) AS inside FROM events e""",
)
def _(s, d):
    return J.within_intervals(
        table(s, d, "events"), spells(s, d), keys="user_id", time="ts", start="onset",
        end="repaired", output="inside",
    ).select("event_id", "user_id", "inside")


@C.add(
    "look_ahead",
    """SELECT event_id, (SELECT round((epoch_us(min(x.ts)) - epoch_us(e.ts)) / 1e6, 3) FROM events x
       WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.ts > e.ts
       AND x.ts <= e.ts + INTERVAL 36 HOUR) AS lead_seconds FROM events e""",
)
def _(s, d):
    e = table(s, d, "events")
    out = J.look_ahead(
        e, e.where("event_type = 'error'"), keys="user_id", time="ts", event_time="ts",
        horizon_seconds=36 * 3600,
    )
    return out.select("event_id", F.round("lead_seconds", 3).alias("lead_seconds"))


@C.add(
    "within_distance",
    f"""WITH p AS ({PLACES}) SELECT a.c_custkey AS query, b.c_custkey AS found,
       round({hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS distance_km
       FROM p a JOIN p b ON
       {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 450""",
)
def _(s, d):
    p = places(s, d)
    out = J.within_distance(p, p, cutoff_km=450)
    return out.select(
        F.col("c_custkey").alias("query"), F.col("c_custkey_h").alias("found"),
        V.half_up(F.col("distance_km"), 4).alias("distance_km"),
    )


@C.add(
    "append",
    """SELECT n_nationkey AS key, n_name AS name, n_nationkey AS extra FROM nation
       UNION ALL SELECT r_regionkey, r_name, NULL FROM region""",
)
def _(s, d):
    n = table(s, d, "nation").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"),
        F.col("n_nationkey").alias("extra"),
    )
    r = table(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return J.append(n, r)


# ---------------------------------------------------------------- aggregates
@C.add(
    "group_aggregate",
    """SELECT l_returnflag, round(sum(l_quantity), 6) AS l_quantity_sum, count(l_quantity) AS count
       FROM lineitem GROUP BY l_returnflag ORDER BY 1""",
)
def _(s, d):
    return A.group_aggregate(
        table(s, d, "lineitem"), group_by="l_returnflag", column="l_quantity", agg="sum"
    )


@C.add(
    "summarise",
    """SELECT p_brand, p_type, count(*) AS row_count, round(avg(p_retailprice), 6) AS p_retailprice_mean,
       round(median(p_size), 6) AS p_size_median, CAST(count(*) AS DOUBLE) AS p_name_count
       FROM part GROUP BY p_brand, p_type""",
)
def _(s, d):
    return A.summarise(
        table(s, d, "part"), group_by="p_brand,p_type",
        measures={"p_retailprice": "mean", "p_size": "median", "p_name": "count"},
    )


@C.add(
    "summarise_lineitem",
    """SELECT l_returnflag, l_linestatus, count(*) AS row_count, round(sum(l_quantity), 2) AS l_quantity_sum,
       round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(min(l_discount), 6) AS l_discount_min,
       round(max(l_tax), 6) AS l_tax_max FROM lineitem GROUP BY ALL""",
)
def _(s, d):
    out = A.summarise(
        table(s, d, "lineitem"), group_by="l_returnflag,l_linestatus",
        measures={"l_quantity": "sum", "l_extendedprice": "mean", "l_discount": "min",
                  "l_tax": "max"},
    )
    return out.withColumns({
        "l_quantity_sum": F.round("l_quantity_sum", 2),
        "l_extendedprice_mean": F.round("l_extendedprice_mean", 4),
    })


@C.add(
    "explore_aggregate",
    """SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity_mean, round(avg(l_tax), 6) AS l_tax_mean
       FROM lineitem GROUP BY l_suppkey""",
)
def _(s, d):
    out = A.explore_aggregate(
        table(s, d, "lineitem"), by="l_suppkey", columns="l_quantity,l_tax", agg="mean"
    )
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@C.add(
    "explore_count",
    """SELECT CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind, count(*) AS count
       FROM events GROUP BY 1""",
)
def _(s, d):
    e = table(s, d, "events").select(
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), "value"
    )
    return A.explore_aggregate(e, by="kind", columns="value", agg="count")


def _profile_sql(column, numeric, kind):
    number = f"CAST({column} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    top = "CAST(NULL AS VARCHAR)" if numeric else f"""(SELECT string_agg(concat(v, ' ', n), ', ' ORDER BY n DESC, v) FROM
      (SELECT {column} AS v, count(*) AS n FROM e WHERE {column} IS NOT NULL GROUP BY ALL ORDER BY n DESC, v LIMIT 12))"""
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, count(*) AS count,
      count(*) - count({column}) AS null_count, round((count(*) - count({column})) / count(*), 4) AS null_ratio,
      count(DISTINCT {column}) AS distinct_count, min({number}) AS min, max({number}) AS max,
      round(avg({number}), 6) AS mean, median({number}) AS median,
      round(stddev_samp({number}), 6) AS stddev, {top} AS top_values FROM e"""


@C.add(
    "profile",
    "WITH e AS (SELECT user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events) "
    + " UNION ALL ".join(
        _profile_sql(c, n, k)
        for c, n, k in (("user_id", True, "bigint"), ("event_type", False, "string"),
                        ("value", True, "double"))
    ),
)
def _(s, d):
    e = table(s, d, "events").select(
        "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    listed = F.transform("top_values", lambda t: F.concat_ws(" ", t["value"], t["count"]))
    return A.profile(e).withColumn("top_values", F.array_join(listed, ", "))


@C.add(
    "column_stats",
    "SELECT min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS mean FROM customer",
)
def _(s, d):
    return A.column_stats(table(s, d, "customer"), column="c_acctbal").withColumn(
        "mean", F.round("mean", 6)
    )


@C.add("distinct_values", "SELECT DISTINCT p_type FROM part")
def _(s, d):
    return A.distinct_values(table(s, d, "part"), column="p_type")


@C.add(
    "value_counts",
    """SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand
       ORDER BY count DESC, value""",
)
def _(s, d):
    return A.value_counts(table(s, d, "part"), column="p_brand")


@C.add(
    "numeric_values",
    """SELECT CAST(substr(c_name, 10) AS DOUBLE) AS digits FROM customer WHERE c_acctbal > 0""",
)
def _(s, d):
    c = table(s, d, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.substring("c_name", 10, 20))
        .otherwise(F.lit("no data")).alias("digits")
    )
    return A.numeric_values(c, column="digits")


@C.add(
    "percent_of_total",
    """SELECT s_suppkey, round(100 * s_acctbal / sum(s_acctbal) OVER (), 4) AS s_acctbal_pct
       FROM supplier""",
)
def _(s, d):
    return A.percent_of_total(
        table(s, d, "supplier").select("s_suppkey", "s_acctbal"), column="s_acctbal"
    ).drop("s_acctbal")


@C.add(
    "zscore_outliers",
    """SELECT event_id, round((value - m) / sd, 6) AS zscore, abs(round((value - m) / sd, 6)) > 2.5 AS is_outlier
       FROM events, (SELECT avg(value) m, stddev_samp(value) sd FROM events)""",
)
def _(s, d):
    out = A.zscore_outliers(table(s, d, "events"), column="value", threshold=2.5)
    return out.select("event_id", "zscore", "is_outlier")


@C.add(
    "linear_trend",
    """WITH f AS (SELECT user_id, count(*) n, regr_slope(value, x) b, avg(value) my, avg(x) mx, min(x) x0,
         CASE WHEN var_pop(value) > 0 THEN regr_r2(value, x) END r2, arg_min(value, ts) v0, arg_max(value, ts) v1
         FROM (SELECT *, epoch_us(ts) / 86400000000.0 AS x FROM events) GROUP BY user_id),
       g AS (SELECT *, CASE WHEN n >= 3 THEN b END s, v1 - v0 ch,
         CASE WHEN v0 <> 0 THEN round(100 * (v1 - v0) / abs(v0), 4) END pct FROM f)
       SELECT user_id, n AS value_points, round(s, 8) AS value_slope_per_day, round(my - s * (mx - x0), 6) AS value_intercept,
         round(CASE WHEN s IS NOT NULL THEN r2 END, 6) AS value_r_squared, v0 AS value_first_value, v1 AS value_last_value,
         round(ch, 6) AS value_change, pct AS value_change_pct,
         CASE WHEN s IS NULL THEN 'unknown' WHEN r2 < 0.2 THEN 'unstable' WHEN abs(coalesce(pct, 0)) < 2 THEN 'stable'
         WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS value_direction FROM g""",
)
def _(s, d):
    out = A.linear_trend(table(s, d, "events"), column="value", group_by="user_id", order_by="ts")
    return out.drop("value_first_seen", "value_last_seen")


def _pair_sql(a, b):
    return f"""SELECT l_returnflag, '{a}' AS measurement_a, '{b}' AS measurement_b,
       round(corr({b}, {a}), 6) AS correlation, count(*) AS points FROM lineitem GROUP BY 1"""


@C.add(
    "correlation",
    " UNION ALL ".join(
        _pair_sql(a, b) for a, b in (
            ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"),
            ("l_extendedprice", "l_discount"))
    ),
)
def _(s, d):
    return A.correlation(
        table(s, d, "lineitem"), columns="l_quantity,l_extendedprice,l_discount",
        group_by="l_returnflag",
    )


def _decisions(s, d):
    return table(s, d, "orders").select(
        F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 250000).alias("said"),
        (F.col("o_orderstatus") == "O").alias("real"),
    )


@C.add(
    "confusion_rates",
    """WITH c AS (SELECT CASE WHEN grouping(year(o_orderdate)) = 1 THEN 'all' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year,
         count(*) FILTER (p AND r) tp, count(*) FILTER (p AND NOT r) fp, count(*) FILTER (NOT p AND r) fn,
         count(*) FILTER (NOT p AND NOT r) tn FROM (SELECT *, o_totalprice > 250000 AS p, o_orderstatus = 'O' AS r FROM orders)
         GROUP BY ROLLUP (year(o_orderdate))),
       r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) pr, coalesce(tp / nullif(tp + fn, 0), 0) re FROM c)
       SELECT year, tp, fp, fn, tn, round(pr, 4) AS precision, round(re, 4) AS recall,
         round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS specificity,
         round((tp + fp) / (tp + fp + fn + tn), 4) AS alert_rate FROM r""",
)
def _(s, d):
    return A.confusion_rates(
        _decisions(s, d), actual="real", predicted="said", group_by="year", total="all"
    )


_LABELLED = """(SELECT o_orderpriority AS actual, CASE WHEN o_totalprice > 300000 THEN '1-URGENT'
    WHEN o_totalprice > 200000 THEN '3-MEDIUM' WHEN o_totalprice > 20000 THEN '5-LOW' END AS said FROM orders)"""


def _labelled(s, d):
    price = F.col("o_totalprice")
    return table(s, d, "orders").select(
        F.col("o_orderpriority").alias("actual"),
        F.when(price > 300000, "1-URGENT").when(price > 200000, "3-MEDIUM")
        .when(price > 20000, "5-LOW").alias("said"),
    )


@C.add(
    "class_accuracy",
    f"""WITH p AS (SELECT actual AS class, count(*) AS total, CAST(count_if(actual = said) AS BIGINT) AS correct
         FROM {_LABELLED} WHERE said IS NOT NULL GROUP BY 1), q AS (SELECT *, correct / total AS accuracy FROM p)
       SELECT class, total, correct, round(accuracy, 6) AS accuracy FROM q
       UNION ALL SELECT '(overall)', CAST(sum(total) AS BIGINT), CAST(sum(correct) AS BIGINT), round(sum(correct) / sum(total), 6) FROM q
       UNION ALL SELECT '(macro)', CAST(sum(total) AS BIGINT), CAST(sum(correct) AS BIGINT), round(avg(accuracy), 6) FROM q""",
)
def _(s, d):
    return A.class_accuracy(_labelled(s, d), actual="actual", predicted="said")


@C.add(
    "confusion_pairs",
    f"""SELECT actual, said AS predicted, count(*) AS count FROM {_LABELLED} WHERE said IS NOT NULL GROUP BY ALL""",
)
def _(s, d):
    return A.confusion_pairs(_labelled(s, d), actual="actual", predicted="said")


@C.add(
    "weighted_aggregate",
    """SELECT l_suppkey, count(*) AS samples, round(sum(l_quantity * l_discount) / nullif(sum(l_discount), 0), 6) AS expected,
       round(sum(CASE WHEN l_quantity >= 10 THEN l_discount ELSE 0 END) / sum(l_discount), 6) AS prob_10,
       round(sum(CASE WHEN l_quantity >= 30 THEN l_discount ELSE 0 END) / sum(l_discount), 6) AS prob_30,
       round(sum(l_discount) * sum(l_discount) / sum(l_discount * l_discount), 1) AS effective
       FROM lineitem GROUP BY l_suppkey""",
)
def _(s, d):
    out = A.weighted_aggregate(
        table(s, d, "lineitem"), value="l_quantity", weight="l_discount", group_by="l_suppkey",
        thresholds=[10, 30],
    )
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "prob_10", "prob_30")})


@C.add(
    "circular_mean",
    """SELECT l_returnflag, round(atan2(avg(sin(l_quantity)), avg(cos(l_quantity))), 6) AS angle
       FROM lineitem GROUP BY 1""",
)
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(A.circular_mean(F.col("l_quantity")), 6).alias("angle")
    )


# ---------------------------------------------------------------- windows
def _readings(s, d):
    """Events with every error reading missing."""
    return table(s, d, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


READINGS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


@C.add(
    "moving_average",
    """WITH k AS (SELECT event_id, v, count(v) OVER (ORDER BY ts, event_id) AS k FROM
         (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events))
       SELECT event_id, round(avg(v) OVER (ORDER BY k RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value_ma3 FROM k""",
)
def _(s, d):
    return W.moving_average(_readings(s, d), column="value", window=3, order_by="ts,event_id").select(
        "event_id", "value_ma3"
    )


_FRAME = "OVER (PARTITION BY user_id ORDER BY k RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)"
_ROLL = f"""WITH k AS (SELECT *, epoch_us(ts) / 1e6 - 1704067200 AS x, count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {READINGS})"""


@C.add(
    "rolling_stats",
    _ROLL + f""", s AS (SELECT event_id, count(value) {_FRAME} AS n, avg(value) {_FRAME} AS m, stddev_samp(value) {_FRAME} AS sd,
         median(value) {_FRAME} AS md, min(value) {_FRAME} AS lo, max(value) {_FRAME} AS hi, sum(value) {_FRAME} AS t,
         last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k, ts, event_id ROWS UNBOUNDED PRECEDING) AS z FROM k)
       SELECT event_id, CASE WHEN n >= 2 THEN round(m, 6) END AS r_mean5, CASE WHEN n >= 2 THEN round(sd, 6) END AS r_std5,
         CASE WHEN n >= 2 THEN round(md, 6) END AS r_median5, CASE WHEN n >= 2 THEN lo END AS r_min5, CASE WHEN n >= 2 THEN hi END AS r_max5,
         CASE WHEN n >= 2 THEN round(t, 6) END AS r_sum5, CASE WHEN n >= 2 THEN CAST(n AS DOUBLE) END AS r_count5,
         CASE WHEN n >= 2 THEN round(hi - lo, 6) END AS r_range5, CASE WHEN n >= 2 AND sd > 0 THEN round((z - m) / sd, 6) END AS r_zscore5
       FROM s""",
)
def _(s, d):
    out = W.rolling_stats(
        _readings(s, d), column="value", window=5, group_by="user_id", order_by="ts,event_id",
        statistics="mean,std,median,min,max,sum,count,range,zscore", prefix="r",
    )
    return out.select("event_id", *[c for c in out.columns if c.startswith("r_")])


@C.add(
    "rolling_slope",
    _ROLL + f""", p AS (SELECT event_id, user_id, k, value, x - min(x) {_FRAME} AS u, x FROM k)
       SELECT event_id, CASE WHEN count(value) {_FRAME} >= 3 THEN round(regr_slope(value, x) {_FRAME} * 86400, 6) END AS r_slope5,
         CASE WHEN count(value) {_FRAME} >= 3 AND max(value) {_FRAME} > min(value) {_FRAME}
           THEN round(regr_r2(value, x) {_FRAME}, 6) END AS r_r_squared5 FROM p""",
)
def _(s, d):
    out = W.rolling_stats(
        _readings(s, d), column="value", window=5, group_by="user_id", order_by="ts,event_id",
        statistics=["slope", "r_squared"], min_periods=3, per="day", prefix="r",
    )
    return out.select("event_id", "r_slope5", "r_r_squared5")


@C.add(
    "lag_column",
    """SELECT event_id, lag(value, 2) OVER w AS value_lag2, lead(event_type, 1) OVER w AS next_type
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(s, d):
    e = table(s, d, "events").drop("props")
    e = W.lag_column(e, column="value", periods=2, group_by="user_id", order_by="ts,event_id")
    e = W.lag_column(
        e, column="event_type", periods=-1, group_by="user_id", order_by="ts,event_id",
        output="next_type",
    )
    return e.select("event_id", "value_lag2", "next_type")


@C.add(
    "lag_column_global",
    f"""SELECT {', '.join(UNIQUE[:4])}, lag(l_quantity) OVER (ORDER BY {', '.join(UNIQUE)}) AS before
       FROM lineitem""",
)
def _(s, d):
    li = table(s, d, "lineitem").select(*UNIQUE, "l_quantity")
    return W.lag_column(li, column="l_quantity", order_by=UNIQUE, output="before").select(
        *UNIQUE[:4], "before"
    )


@C.add(
    "rate_of_change",
    """SELECT event_id, CASE WHEN ts > lag(ts) OVER w THEN round((value - lag(value) OVER w) /
       ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600000000.0), 6) END AS value_per_hour
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(s, d):
    return W.rate_of_change(
        table(s, d, "events"), column="value", group_by="user_id", order_by="ts,event_id"
    ).select("event_id", "value_per_hour")


@C.add(
    "trailing_rows",
    """SELECT user_id, event_id FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""",
)
def _(s, d):
    return W.trailing_rows(
        table(s, d, "events"), k=5, group_by="user_id", order_by="ts,event_id"
    ).select("user_id", "event_id")


def coarse(s, d):
    """Readings in steps of a hundred, so that repeats occur."""
    return _readings(s, d).withColumn("value", F.floor(F.col("value") / 100) * 100)


COARSE = f"(SELECT event_id, ts, user_id, floor(value / 100) * 100 AS v FROM {READINGS})"
RUNS_SQL = f"""SELECT user_id, coalesce(max(CASE WHEN len >= 2 THEN len END), 0) AS longest_flatline FROM (
    SELECT user_id, g, count(*) + CAST(max(CASE WHEN same AND NOT cont THEN 1 ELSE 0 END) AS BIGINT) AS len FROM (
      SELECT *, sum(CASE WHEN same AND cont THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS g FROM (
        SELECT *, coalesce(v = lag(v) OVER w, false) AS same, coalesce(n = lag(n) OVER w + 1, false) AS cont FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {COARSE})
        WHERE v IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY n))) GROUP BY 1, 2) GROUP BY 1"""


@C.add("longest_runs", RUNS_SQL)
def _(s, d):
    out = W.longest_runs(coarse(s, d), column="value", group_by="user_id", order_by="ts,event_id")
    return out.withColumn("longest_flatline", F.col("longest_flatline").cast("long"))


SHIFT_SQL = """SELECT user_id, CASE WHEN count(*) >= 36 THEN round(max(jump) / (stddev_samp(diff) * sqrt(2.0 / 12)), 5) END
    AS largest_step_ratio FROM (SELECT user_id, abs(y - lag(y) OVER w) AS diff,
    CASE WHEN count(y) OVER b = 12 AND count(y) OVER a = 12 THEN abs(avg(y) OVER a - avg(y) OVER b) END AS jump
    FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
    b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) GROUP BY user_id"""


@C.add("level_shift", SHIFT_SQL.format(source=f"(SELECT *, value AS y FROM {READINGS} WHERE value IS NOT NULL)"))
def _(s, d):
    out = W.level_shift(_readings(s, d), column="value", group_by="user_id", order_by="ts,event_id")
    return out.withColumn("largest_step_ratio", F.round("largest_step_ratio", 5))


@C.add(
    "sampling_gaps",
    """SELECT user_id, count(gap) AS intervals, CAST(count_if(gap > 1200) AS BIGINT) AS gaps, round(max(gap), 2) AS largest_gap_minutes
       FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 6e7 AS gap
       FROM events) GROUP BY user_id""",
)
def _(s, d):
    return W.sampling_gaps(
        table(s, d, "events").drop("props"), time="ts", group_by="user_id", interval_minutes=600,
        tie_break="event_id",
    )


@C.add(
    "half_drift",
    f"""SELECT user_id, CASE WHEN stddev_samp(CASE WHEN n <= c // 2 THEN value END) > 0 THEN
       round(abs(avg(CASE WHEN n > c // 2 THEN value END) - avg(CASE WHEN n <= c // 2 THEN value END)) / stddev_samp(CASE WHEN n <= c // 2 THEN value END), 5) END AS drift_sigma
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c
       FROM {READINGS} WHERE value IS NOT NULL) GROUP BY user_id""",
)
def _(s, d):
    out = W.half_drift(_readings(s, d), column="value", group_by="user_id", order_by="ts,event_id")
    return out.withColumn("drift_sigma", F.round("drift_sigma", 5))


# ---------------------------------------------------------------- reshape
@C.add(
    "pivot_wider",
    """SELECT user_id, """ + ", ".join(
        f"round(avg(value) FILTER (event_type = '{t}'), 6) AS e_{t}"
        for t in ("click", "error", "purchase", "signup", "view")
    ) + " FROM events GROUP BY user_id",
)
def _(s, d):
    return S.pivot_wider(
        table(s, d, "events"), keys="user_id", name_from="event_type", value_from="value",
        prefix="e_", order_by="ts,event_id",
    )


@C.add(
    "pivot_wider_last",
    """SELECT o_custkey, """ + ", ".join(
        f"arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = '{t}') AS \"{t}\""
        for t in ("F", "O", "P")
    ) + " FROM orders GROUP BY o_custkey",
)
def _(s, d):
    return S.pivot_wider(
        table(s, d, "orders"), keys="o_custkey", name_from="o_orderstatus",
        value_from="o_orderpriority", aggregation="last", order_by="o_orderdate,o_orderkey",
    )


@C.add(
    "unpivot_longer",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{c}' AS measurement, {c} AS value FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def _(s, d):
    return S.unpivot_longer(
        table(s, d, "lineitem"), keys="l_orderkey,l_linenumber",
        columns="l_quantity,l_discount,l_tax",
    )


@C.add(
    "resample_day",
    f"""SELECT event_type, strftime(ts, '%Y-%m-%d') AS period, count(*) AS sample_count, round(avg(value), 6) AS value_mean,
       max(value) AS value_max, round(stddev_samp(value), 6) AS value_std, arg_min(value, (ts, event_id)) AS value_first,
       arg_max(value, (ts, event_id)) AS value_last, round(median(value), 6) AS value_median
       FROM events GROUP BY ALL""",
)
def _(s, d):
    return S.resample_time(
        table(s, d, "events"), timestamp="ts", period="day", group_by="event_type",
        measures={"value": ["mean", "max", "std", "first", "last", "median"]}, order_by="event_id",
    )


@C.add(
    "resample_week",
    """SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) AS sample_count,
       round(sum(o_totalprice), 2) AS o_totalprice_sum, CAST(count(o_totalprice) AS DOUBLE) AS o_totalprice_count
       FROM orders GROUP BY 1""",
)
def _(s, d):
    out = S.resample_time(
        table(s, d, "orders"), timestamp="o_orderdate", period="week", output="week",
        measures={"o_totalprice": ["sum", "count"]},
    )
    return out.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))


@C.add(
    "resample_quarter",
    """SELECT o_orderstatus, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, count(*) AS sample_count,
       min(o_totalprice) AS o_totalprice_min FROM orders GROUP BY ALL""",
)
def _(s, d):
    return S.resample_time(
        table(s, d, "orders"), timestamp="o_orderdate", period="quarter", group_by="o_orderstatus",
        measures={"o_totalprice": "min"},
    )


# ---------------------------------------------------------------- charts
@C.add(
    "plain_series",
    """SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders
       ORDER BY o_orderdate, o_orderkey""",
)
def _(s, d):
    return K.plain_series(
        table(s, d, "orders"), x="o_orderkey", y="o_totalprice,o_custkey",
        order_by="o_orderdate,o_orderkey",
    )


@C.add(
    "aggregated_series",
    """SELECT p_brand, round(avg(p_retailprice), 6) AS p_retailprice_mean, round(avg(p_size), 6) AS p_size_mean
       FROM part GROUP BY p_brand ORDER BY CASE p_brand WHEN 'Brand#9' THEN 0 ELSE 1 END, p_brand LIMIT 10""",
)
def _(s, d):
    return K.aggregated_series(
        table(s, d, "part"), x="p_brand", y="p_retailprice,p_size", aggregation="mean",
        stated=["Brand#9"], limit=10,
    )


@C.add(
    "histogram",
    """WITH e AS (SELECT min(value) lo, (max(value) - min(value)) / 12 w FROM events),
       c AS (SELECT CAST(least(11, floor((value - lo) / w)) AS BIGINT) AS b, count(*) n FROM events, e GROUP BY 1)
       SELECT i AS bucket, round(lo + w * i, 6) AS lower, round(lo + w * (i + 1), 6) AS upper, coalesce(n, 0) AS count
       FROM e, range(12) t(i) LEFT JOIN c ON b = i""",
)
def _(s, d):
    out = K.histogram(table(s, d, "events"), column="value")
    return out.select(
        "bucket", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "count"
    )


@C.add(
    "distribution",
    """SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean,
       count(*) AS counted, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
       FROM lineitem""",
)
def _(s, d):
    out = K.distribution(table(s, d, "lineitem"), column="l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p90")})


_BOX = """q AS (SELECT event_type k, quantile_cont(value, 0.25) q1, median(value) q2, quantile_cont(value, 0.75) q3
    FROM events GROUP BY 1), f AS (SELECT k, value v, q1, q2, q3, q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi
    FROM events JOIN q ON event_type = k)"""


@C.add(
    "box",
    f"""WITH {_BOX} SELECT k AS event_type, min(v) FILTER (v BETWEEN lo AND hi) AS min, round(any_value(q1), 6) AS q1,
       round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, max(v) FILTER (v BETWEEN lo AND hi) AS max,
       count(*) FILTER (NOT v BETWEEN lo AND hi) AS outliers, count(*) AS size FROM f GROUP BY k""",
)
def _(s, d):
    out = K.box(table(s, d, "events"), x="event_type", y="value")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@C.add(
    "box_outliers",
    f"""WITH {_BOX} SELECT k AS category, v AS value FROM f WHERE NOT v BETWEEN lo AND hi""",
)
def _(s, d):
    return K.box_outliers(table(s, d, "events"), x="event_type", y="value")


@C.add(
    "grid",
    """WITH c AS (SELECT p_brand, p_type, round(sum(p_size), 6) AS value FROM part GROUP BY ALL)
       SELECT x.p_brand, y.p_type, CAST(value AS DOUBLE) AS value FROM (SELECT DISTINCT p_brand FROM c) x
       CROSS JOIN (SELECT DISTINCT p_type FROM c) y LEFT JOIN c ON c.p_brand = x.p_brand AND c.p_type = y.p_type""",
)
def _(s, d):
    return K.grid(
        table(s, d, "part"), x="p_brand", series="p_type", y="p_size",
        aggregation="sum",
    )


@C.add(
    "grid_count",
    """WITH c AS (SELECT month(o_orderdate) AS m, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY ALL)
       SELECT x.m AS month, y.st AS status, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT m FROM c) x
       CROSS JOIN (SELECT DISTINCT st FROM c) y LEFT JOIN c ON c.m = x.m AND c.st = y.st""",
)
def _(s, d):
    o = table(s, d, "orders").select(
        F.month("o_orderdate").cast("long").alias("month"), F.col("o_orderstatus").alias("status"),
        "o_totalprice",
    )
    return K.grid(o, x="month", series="status", y="o_totalprice", aggregation="count")


@C.add(
    "group_max_rows",
    """SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 10""",
)
def _(s, d):
    return R.top_per_group(
        table(s, d, "orders"), k=10, group_by="o_orderstatus", order_by="-o_totalprice,o_orderkey"
    ).select("o_orderstatus", "o_orderkey", "o_totalprice")


@C.add("seven_transforms", """SELECT CAST(year(l_shipdate) AS BIGINT) AS s_year, CASE WHEN l_quantity < 10 THEN '1-10' WHEN l_quantity < 30 THEN '10-30' ELSE '30-50' END AS l_quantity_band,
       count(*) AS row_count, round(sum(l_extendedprice), 2) AS price_sum, round(avg(l_suppkey), 6) AS tag_value_mean
       FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL ORDER BY ALL""")
def _(s, d):
    """Seven chained transforms over forty columns."""
    from fathomline.plans.compose import run_plan

    li = table(s, d, "lineitem").withColumns({
        "price": F.col("l_extendedprice").cast("string"),
        "tag": F.concat(F.lit("x"), F.col("l_suppkey").cast("string"), F.lit(" kg")),
        **{f"extra_{i}": F.col("l_partkey") + i for i in range(27)},
    })
    out = run_plan(
        [
            {"name": "cast", "use": "cast_types", "options": {"casts": {"price": "number"}}},
            {"name": "parse", "use": "parse_numeric", "options": {"column": "tag"}},
            {"name": "parts", "use": "datetime_parts",
             "options": {"column": "l_shipdate", "parts": "year,month", "prefix": "s"}},
            {"name": "band", "use": "bin_numeric", "options": {"column": "l_quantity", "edges": [1, 10, 30, 50]}},
            {"name": "kept", "use": "filter_rows", "options": {"column": "l_discount", "op": "gt", "value": 0.02}},
            {"name": "sums", "use": "summarise",
             "options": {"group_by": "s_year,l_quantity_band", "measures": {"price": "sum", "tag_value": "mean"}}},
            {"name": "sorted", "use": "sort_rows", "options": {"column": "s_year,l_quantity_band"}},
        ],
        li,
    )["sorted"]
    return out.withColumn("price_sum", F.round("price_sum", 2))
