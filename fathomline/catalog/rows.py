"""Projection, filters, derived columns, scalars, order."""

from pyspark.sql import functions as F

from fathomline.catalog.base import Catalog, table
from fathomline.functions.geo import great_circle_km, polar, similarity
from fathomline.operators import rows as R

C = Catalog()
UNIQUE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@C.add("select_columns", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def _(s, d):
    return R.select_columns(table(s, d, "lineitem"), columns="l_orderkey, l_partkey, l_quantity")


@C.add("drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(s, d):
    return R.drop_columns(table(s, d, "customer"), columns=["c_name", "c_mktsegment", "nope"])


@C.add("rename_columns", "SELECT s_suppkey AS supplier, s_name, s_nationkey AS nation, s_acctbal FROM supplier")
def _(s, d):
    return R.rename_columns(
        table(s, d, "supplier"), mapping={"s_suppkey": "supplier", "s_nationkey": "nation"}
    )


@C.add(
    "cast_types",
    """SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice,
       CAST(l_partkey AS DOUBLE) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey,
       CAST(l_linenumber = 1 AS BOOLEAN) AS first_line
       FROM lineitem""",
)
def _(s, d):
    li = table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey",
        F.col("l_linenumber").alias("first_line"),
    )
    return R.cast_types(
        li,
        casts={"l_extendedprice": "integer", "l_partkey": "number", "l_suppkey": "text",
               "first_line": "boolean"},
    )


@C.add(
    "fill_missing",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value,
       CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS kind FROM events""",
)
def _(s, d):
    e = table(s, d, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("event_type")).alias("kind"),
    )
    return R.fill_missing(R.fill_missing(e, columns="value", value=0), columns="kind", value="none")


@C.add(
    "filter_rows_text",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F'
       AND o_orderpriority IS NOT NULL""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    o = R.filter_rows(o, column="o_orderpriority", op="in", value=["1-URGENT", "2-HIGH"])
    o = R.filter_rows(o, column="o_orderstatus", op="not_equals", value="F")
    return R.filter_rows(o, column="o_orderpriority")


@C.add(
    "filter_rows_number",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE l_quantity > 24 AND l_discount <= 0.05""",
)
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    li = R.filter_rows(li, column="l_quantity", op="gt", value=24)
    return R.filter_rows(li, column="l_discount", op="lte", value=0.05)


@C.add(
    "flag_rows",
    """SELECT p_partkey, contains(p_name, 'ring') AS is_ring, p_size >= 25 AS big,
       p_brand = 'Brand#2' AS p_brand_flag FROM part""",
)
def _(s, d):
    p = table(s, d, "part")
    p = R.flag_rows(p, column="p_name", op="contains", value="ring", output="is_ring")
    p = R.flag_rows(p, column="p_size", op="gte", value=25, output="big")
    p = R.flag_rows(p, column="p_brand", op="equals", value="Brand#2")
    return p.select("p_partkey", "is_ring", "big", "p_brand_flag")


@C.add(
    "explore_filter",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
       WHERE l_quantity >= 10 AND l_quantity < 40 AND l_returnflag <> 'N'
       AND lower(l_linestatus) LIKE '%o%' AND l_suppkey IN (1, 2, 3, 5, 8, 13)
       AND l_partkey IS NOT NULL""",
)
def _(s, d):
    return R.explore_filter(
        table(s, d, "lineitem"),
        conditions=[
            {"column": "l_quantity", "op": "gte", "value": "10"},
            {"column": "l_quantity", "op": "lt", "value": 40},
            {"column": "l_returnflag", "op": "ne", "value": "N"},
            {"column": "l_linestatus", "op": "contains", "value": "O"},
            {"column": "l_suppkey", "op": "in", "value": ["1", "2", 3, 5, "8", 13.0]},
            {"column": "l_partkey", "op": "not_null"},
        ],
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@C.add(
    "explore_query",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'
       ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50 OFFSET 20""",
)
def _(s, d):
    return R.explore_query(
        table(s, d, "orders"),
        columns=["o_orderkey", "o_custkey", "o_totalprice"],
        conditions=[{"column": "o_orderstatus", "op": "eq", "value": "O"}],
        sort_by=["o_totalprice", "o_orderkey"], descending=True, limit=50, offset=20,
    )


@C.add("explore_total", "SELECT count(*) AS total FROM orders WHERE o_totalprice > 200000")
def _(s, d):
    return R.explore_total(
        table(s, d, "orders"),
        conditions=[{"column": "o_totalprice", "op": "gt", "value": "200000"}],
    )


@C.add(
    "formula",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
       CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 4) END AS ratio FROM lineitem""",
)
def _(s, d):
    out = R.formula(
        table(s, d, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"
        ),
        expressions={
            "raw": "l_extendedprice * (1 - l_discount)",
            "net": "round(raw, 4)",
            "charge": "round(raw * (1 + l_tax), 6)",
            "ratio": "round(try_divide(l_tax, l_discount), 4)",
        },
    )
    return out.select("l_orderkey", "l_linenumber", "net", "charge", "ratio")


@C.add(
    "formula_failures",
    """SELECT count(*) AS rows, CAST(count_if(l_discount = 0) AS BIGINT) AS failed_ratio FROM lineitem""",
)
def _(s, d):
    out = R.formula(table(s, d, "lineitem"), expressions={"ratio": "l_tax / l_discount"})
    return R.formula_failures(out, outputs="ratio", inputs="l_tax,l_discount")


@C.add(
    "formula_failing_rows",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS ratio,
       CAST(NULL AS INTEGER) AS number, CASE WHEN l_quantity > 25 THEN 'many' END AS size FROM lineitem""",
)
def _(s, d):
    out = R.formula(table(s, d, "lineitem"), expressions={
        "ratio": "round(l_tax / l_discount, 6)", "number": "cast(l_returnflag as int)",
        "size": "case when l_quantity > 25 then 'many' end",
    })
    return out.select("l_orderkey", "l_linenumber", "ratio", "number", "size")


@C.add(
    "rule_failing_rows",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 AND l_tax / l_discount > 1 THEN 'taxed' ELSE 'plain' END AS kind FROM lineitem""",
)
def _(s, d):
    out = R.rule(
        table(s, d, "lineitem"), default={"kind": "plain"},
        rules=[{"name": "bad", "when": "cast(l_returnflag as int) > 0", "then": {"kind": "bad"}},
               {"name": "taxed", "when": "case when l_tax / l_discount > 1 then true else false end", "then": {"kind": "taxed"}}],
    )
    return out.select("l_orderkey", "l_linenumber", "kind")


@C.add(
    "expression_vocabulary",
    """SELECT l_orderkey, l_linenumber, l_partkey % 7 AS rest,
       CAST(floor(l_quantity / 7) AS BIGINT) AS whole, round(sqrt(l_quantity), 6) AS root,
       round(ln(l_extendedprice), 6) AS log_price, greatest(l_discount, l_tax) AS larger,
       round(abs(sin(l_quantity)), 6) AS wave,
       CASE WHEN l_quantity > 10 AND l_quantity <= 20 THEN 'mid' ELSE 'edge' END AS class,
       l_returnflag IN ('A', 'R') AS returned
       FROM lineitem""",
)
def _(s, d):
    return R.formula(
        table(s, d, "lineitem"),
        expressions={
            "rest": "l_partkey - 7 * floor(l_partkey / 7)",
            "whole": "floor(l_quantity / 7)",
            "root": "round(sqrt(l_quantity), 6)",
            "log_price": "round(ln(l_extendedprice), 6)",
            "larger": "greatest(l_discount, l_tax)",
            "wave": "round(abs(sin(l_quantity)), 6)",
            "class": "if(l_quantity > 10 and l_quantity <= 20, 'mid', 'edge')",
            "returned": "l_returnflag in ('A', 'R')",
        },
    ).select("l_orderkey", "l_linenumber", "rest", "whole", "root", "log_price", "larger",
             "wave", "class", "returned")


RULES = [
    {"name": "urgent", "when": "o_orderpriority = '1-URGENT'", "then": {"lane": "fast", "fee": 20}},
    {"name": "large", "when": "o_totalprice > 300000", "then": {"lane": "care"}},
    {"name": "open", "when": "o_orderstatus = 'O'", "then": {"lane": "queue", "fee": 5}},
]
_RULE_SQL = """WITH m AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS u,
    o_totalprice > 300000 AS l, o_orderstatus = 'O' AS p FROM orders)"""


@C.add(
    "rule_first_match",
    _RULE_SQL + """SELECT o_orderkey,
       CASE WHEN u THEN 'fast' WHEN l THEN 'care' WHEN p THEN 'queue' ELSE 'none' END AS lane,
       CAST(CASE WHEN u THEN 20 WHEN l THEN NULL WHEN p THEN 5 END AS INTEGER) AS fee,
       CASE WHEN u THEN 'urgent' WHEN l THEN 'large' WHEN p THEN 'open' ELSE '' END AS matched_rules
       FROM m""",
)
def _(s, d):
    out = R.rule(table(s, d, "orders"), rules=RULES, default={"lane": "none"})
    return out.select("o_orderkey", "lane", "fee",
                      F.array_join("matched_rules", ",").alias("matched_rules"))


@C.add(
    "rule_all_matches",
    _RULE_SQL + """SELECT o_orderkey,
       CASE WHEN p THEN 'queue' WHEN l THEN 'care' WHEN u THEN 'fast' ELSE 'none' END AS lane,
       CAST(CASE WHEN p THEN 5 WHEN u THEN 20 END AS INTEGER) AS fee,
       concat_ws(',', CASE WHEN u THEN 'urgent' END, CASE WHEN l THEN 'large' END,
                 CASE WHEN p THEN 'open' END) AS matched_rules FROM m""",
)
def _(s, d):
    out = R.rule(table(s, d, "orders"), rules=RULES, default={"lane": "none"}, mode="all_matches")
    return out.select("o_orderkey", "lane", "fee",
                      F.array_join("matched_rules", ",").alias("matched_rules"))


@C.add(
    "rule_metrics",
    _RULE_SQL + """SELECT count(*) AS rows, CAST(count_if(NOT (u OR l OR p)) AS BIGINT) AS unmatched,
       round(1 - count_if(NOT (u OR l OR p)) / count(*), 4) AS match_rate,
       CAST(count_if(u) AS BIGINT) AS hits_urgent, CAST(count_if(l) AS BIGINT) AS hits_large, CAST(count_if(p) AS BIGINT) AS hits_open FROM m""",
)
def _(s, d):
    out = R.rule(table(s, d, "orders"), rules=RULES, mode="all_matches")
    return R.rule_metrics(out, rules=RULES)


@C.add(
    "parse_numeric",
    """SELECT c_custkey, CAST(regexp_extract(replace(c_name, ',', ''), '-?[0-9]+([0-9,]*[0-9])?([.][0-9]+)?')
       AS DOUBLE) AS c_name_value FROM customer""",
)
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return R.parse_numeric(c, column="c_name", keep_original=False)


@C.add(
    "extract_pattern",
    """SELECT event_id, CASE WHEN regexp_matches(props, '"k": *(4[0-9])')
       THEN regexp_extract(props, '"k": *(4[0-9])', 1) END AS forty FROM events""",
)
def _(s, d):
    e = table(s, d, "events").select("event_id", "props")
    return R.extract_pattern(
        e, column="props", pattern=r'"k": *(4\d)', group=1, output="forty"
    ).drop("props")


@C.add(
    "datetime_parts",
    """SELECT o_orderkey, year(o_orderdate) AS o_year, month(o_orderdate) AS o_month,
       day(o_orderdate) AS o_day, hour(o_orderdate) AS o_hour, dayofyear(o_orderdate) AS o_dayofyear,
       week(o_orderdate) AS o_week, quarter(o_orderdate) AS o_quarter,
       strftime(o_orderdate, '%Y-%m-%d') AS o_date FROM orders""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    return R.datetime_parts(o, column="o_orderdate", parts=R.DATE_PARTS, prefix="o").drop("o_orderdate")


@C.add(
    "duration_between",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate >= o_orderdate THEN
       round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0, 3) END AS waited
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return R.duration_between(
        both, start="o_orderdate", end="l_shipdate", unit="days", output="waited"
    ).select("l_orderkey", "l_linenumber", "waited")


@C.add(
    "bin_numeric",
    """SELECT p_partkey, CASE WHEN p_size < 5 THEN 'below range' WHEN p_size < 15 THEN '5-15'
       WHEN p_size < 32.7 THEN '15-32.7' WHEN p_size <= 45 THEN '32.7-45' ELSE 'above range' END
       AS p_size_band FROM part""",
)
def _(s, d):
    p = table(s, d, "part").select("p_partkey", "p_size")
    return R.bin_numeric(p, column="p_size", edges=[5, 15, 32.7, 45]).drop("p_size")


@C.add(
    "map_values",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled'
       ELSE o_orderstatus END AS o_orderstatus_label FROM orders""",
)
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return R.map_values(o, column="o_orderstatus", mapping={"O": "open", "F": "filled"}).drop(
        "o_orderstatus"
    )


@C.add(
    "map_values_table",
    """SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier
       LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def _(s, d):
    codes = table(s, d, "nation").select(F.col("n_nationkey").cast("string"), "n_name")
    return R.map_values(
        table(s, d, "supplier").select("s_suppkey", "s_nationkey"),
        column="s_nationkey", mapping=codes, default="unknown", output="nation",
    ).drop("s_nationkey")


def places(s, d):
    """Positions derived from customers: balance and key spread over the globe."""
    return table(s, d, "customer").select(
        "c_custkey",
        (F.pmod(F.col("c_acctbal"), F.lit(120.0)) - 60).alias("lat"),
        (F.pmod(F.col("c_custkey") * 37, F.lit(360)) - 180).cast("double").alias("lon"),
    )


PLACES = """SELECT c_custkey, (c_acctbal - 120.0 * floor(c_acctbal / 120.0)) - 60 AS lat,
    CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS lon FROM customer"""
_HAV = """2 * 6371.0 * asin(sqrt(pow(sin(radians({a2} - {a1}) / 2), 2)
    + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({b2} - {b1}) / 2), 2)))"""


def hav_sql(a1, b1, a2, b2):
    return _HAV.format(a1=a1, b1=b1, a2=a2, b2=b2)


@C.add(
    "geo_distance",
    f"""WITH p AS ({PLACES}) SELECT c_custkey,
    round({hav_sql('23.7', '121.0', 'lat', 'lon')}, 4) AS km,
    round(exp(-{hav_sql('23.7', '121.0', 'lat', 'lon')} / 150.0), 6) AS score,
    round(atan2(lat - 23.7, (lon - 121.0) * cos(radians(lat))), 6) AS theta FROM p""",
)
def _(s, d):
    p = places(s, d)
    km = great_circle_km(F.lit(23.7), F.lit(121.0), F.col("lat"), F.col("lon"))
    _r, theta = polar(F.col("lat"), F.col("lon"), 23.7, 121.0)
    return p.select(
        "c_custkey", F.round(km, 4).alias("km"), F.round(similarity(km), 6).alias("score"),
        F.round(theta, 6).alias("theta"),
    )


@C.add(
    "sort_rows",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey",
)
def _(s, d):
    return R.sort_rows(
        table(s, d, "customer").select("c_custkey", "c_acctbal"), column=["-c_acctbal", "c_custkey"]
    )


@C.add(
    "limit_rows",
    "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 25",
)
def _(s, d):
    return R.limit_rows(
        table(s, d, "events"), count=25, from_end=True, order_by="ts, event_id"
    ).select("event_id", "value")


@C.add(
    "page",
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       ORDER BY {', '.join(UNIQUE)} LIMIT 40 OFFSET 100""",
)
def _(s, d):
    return R.page(table(s, d, "lineitem"), offset=100, length=40, order_by=UNIQUE).select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )


@C.add(
    "drop_duplicates",
    """SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1""",
)
def _(s, d):
    return R.drop_duplicates(
        table(s, d, "orders"), columns="o_custkey,o_orderstatus", order_by="o_orderdate,o_orderkey"
    ).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@C.add("drop_duplicates_all", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def _(s, d):
    return R.drop_duplicates(table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax"))


@C.add(
    "latest_per_key",
    """SELECT user_id, event_type, event_id, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(s, d):
    return R.latest_per_key(
        table(s, d, "events"), keys="user_id,event_type", order_by="ts,event_id"
    ).select("user_id", "event_type", "event_id", "value")


@C.add(
    "top_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders
       QUALIFY place <= 3""",
)
def _(s, d):
    return R.top_per_group(
        table(s, d, "orders"), k=3, group_by="o_custkey", order_by="-o_totalprice,o_orderkey",
        output="place",
    ).select("o_custkey", "o_orderkey", "o_totalprice", "place")


@C.add(
    "rank_rows",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)
       AS o_totalprice_rank FROM orders""",
)
def _(s, d):
    return R.rank_rows(
        table(s, d, "orders").select("o_orderkey", "o_totalprice"), column="o_totalprice",
        order_by="o_orderkey",
    )


@C.add(
    "rank_rows_in_group",
    """SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand
       ORDER BY p_size, p_partkey) AS p_size_rank FROM part""",
)
def _(s, d):
    return R.rank_rows(
        table(s, d, "part").select("p_partkey", "p_brand", "p_size"), column="p_size",
        descending=False, group_by="p_brand", order_by="p_partkey",
    )


@C.add(
    "category_order",
    """SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY CASE o_orderpriority
       WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority""",
)
def _(s, d):
    counts = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return R.category_order(
        counts, column="o_orderpriority", stated=["3-MEDIUM", "1-URGENT"]
    )
