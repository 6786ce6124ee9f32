"""Reading and versioning tables, composed plans, runs and lineage."""

import uuid

from pyspark.sql import functions as F

from fathomline.catalog.base import Catalog, table
from fathomline.plans import compose, lineage, runs
from fathomline.session import scratch_folder
from fathomline.sources import readers
from fathomline.sources.versions import Datasets

C = Catalog()


def _place(s, kind):
    return f"{scratch_folder(s)}/catalog-{uuid.uuid4().hex}.{kind}"


@C.add("read_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey IS NOT NULL")
def _(s, d):
    path = _place(s, "csv")
    table(s, d, "supplier").write.csv(path, header=True)
    out = readers.read_uri(s, path)
    return out.withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))


@C.add("read_ndjson", "SELECT event_id, event_type, value FROM events")
def _(s, d):
    path = _place(s, "ndjson")
    table(s, d, "events").select("event_id", "event_type", "value").write.json(path)
    return readers.read_uri(s, path)


@C.add("read_json_document", "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def _(s, d):
    orders = table(s, d, "orders").groupBy("o_custkey").agg(
        F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders")
    )
    docs = table(s, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", "c_mktsegment", F.struct("orders").alias("body")
    )
    flat = readers.flatten_nested(docs)
    back = readers.parse_nested(
        flat, schemas={"body": "struct<orders:array<struct<o_orderkey:bigint,o_totalprice:double>>>"}
    )
    return back.select("c_custkey", "c_mktsegment", F.inline("body.orders"))


@C.add("read_json_records", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(s, d):
    """Documents of at most a thousand customers, each a file with its records two levels down."""
    path = _place(s, "json")
    rows = F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))
    docs = table(s, d, "customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("part")).agg(
        F.to_json(F.struct(F.struct(rows.alias("rows")).alias("body"), F.count(F.lit(1)).alias("total"))).alias("value")
    )
    docs.write.partitionBy("part").text(path)
    return readers.read_json(s, path, records_path="body.rows").select("c_custkey", "c_name", "c_acctbal")


@C.add("read_parquet_columns", "SELECT l_orderkey, l_shipdate FROM lineitem")
def _(s, d):
    return readers.read_parquet(s, f"{d}/lineitem.parquet", columns="l_orderkey,l_shipdate")


@C.add("promote_text", "SELECT event_id, value, event_type, k FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def _(s, d):
    e = table(s, d, "events").select(
        F.col("event_id").cast("string"), F.col("value").cast("string"), "event_type",
        F.get_json_object("props", "$.k").alias("k"),
    )
    return readers.promote_text(e)


@C.add("describe_schema", """SELECT * FROM (VALUES ('l_orderkey', 'integer'), ('l_partkey', 'integer'), ('l_suppkey', 'integer'), ('l_linenumber', 'integer'),
       ('l_quantity', 'float'), ('l_extendedprice', 'float'), ('l_discount', 'float'), ('l_tax', 'float'), ('l_returnflag', 'string'),
       ('l_linestatus', 'string'), ('l_shipdate', 'timestamp')) v(name, type)""")
def _(s, d):
    return readers.inline_rows(s, readers.describe_schema(table(s, d, "lineitem"))).drop("nullable")


@C.add("contract_of_text", """SELECT * FROM (VALUES ('errors', 'column ''c_segment'' is missing'), ('warnings', 'column ''c_name'' is string, wanted integer'),
       ('warnings', 'column ''c_nationkey'' is integer, wanted string')) v(level, message) WHERE EXISTS (SELECT 1 FROM customer)""")
def _(s, d):
    """A contract against a table read back from text, whose types every row decides."""
    path = _place(s, "csv")
    table(s, d, "customer").write.csv(path, header=True)
    found = readers.check_contract(readers.read_csv(s, path), [
        {"name": "c_custkey", "type": "integer"}, {"name": "c_name", "type": "integer"},
        {"name": "c_acctbal", "type": "integer"}, {"name": "c_nationkey", "type": "string"},
        {"name": "c_segment", "type": "string"}, {"name": "c_comment", "type": "string", "required": False},
    ])
    return s.createDataFrame([(k, m) for k, said in found.items() for m in said], "level string, message string")


@C.add("dataset_versions", """SELECT 'customer' AS dataset, CAST(1 AS BIGINT) AS version, count(*) AS rows, CAST(5 AS BIGINT) AS columns FROM customer
       UNION ALL SELECT 'customer', 2, count(*), 5 FROM customer WHERE c_acctbal > 0""")
def _(s, d):
    store, c = Datasets(s, _place(s, "store")), table(s, d, "customer")
    store.write(c, "customer", lineage={"from": "customer"})
    store.refresh("customer", lambda _s: c.where("c_acctbal > 0"))
    return store.versions().select("dataset", "version", "rows", "columns")


@C.add("dataset_pinned", "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(s, d):
    store, o = Datasets(s, _place(s, "store")), table(s, d, "orders")
    first = store.write(o.where("o_totalprice > 100000"), "orders", partition_by="o_orderstatus")
    store.write(o, "orders")
    return store.read("orders", version=first, columns="o_orderstatus,o_orderkey,o_totalprice")


@C.add("dataset_preview", """SELECT least(count(*), 100) AS shown, count(*) AS total, CAST(3 AS BIGINT) AS fields,
       (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS first_version FROM orders""")
def _(s, d):
    """The size of the newest version's first page, the rows and columns listed for it, and the rows of the version before."""
    store = Datasets(s, _place(s, "store"))
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = store.write(o.where("o_totalprice > 100000"), "orders")
    store.write(o, "orders")
    page, schema, total = store.preview("orders")
    return page.agg(F.count(F.lit(1)).alias("shown")).select(
        "shown", F.lit(total).cast("bigint").alias("total"), F.lit(len(schema)).cast("bigint").alias("fields"),
        F.lit(store.row_count("orders", version=first)).cast("bigint").alias("first_version"),
    )


@C.add("steps_from_query", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 300000
       ORDER BY o_totalprice DESC""")
def _(s, d):
    steps = compose.steps_from_query(
        columns=["o_orderkey", "o_totalprice"], sort_by="o_totalprice", descending=True,
        conditions=[{"column": "o_orderstatus", "op": "eq", "value": "O"},
                    {"column": "o_totalprice", "op": "gte", "value": 300000}],
    )
    return compose.run_plan(steps, table(s, d, "orders"))["select"]


@C.add("nested_plan", """SELECT n_name, count(*) AS row_count, round(sum(c_acctbal), 2) AS c_acctbal_sum FROM customer
       JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000 GROUP BY n_name""")
def _(s, d):
    plans = {
        "rich": [
            {"name": "rich", "use": "filter_rows",
             "options": {"column": "c_acctbal", "op": "gt", "value": 1000}},
        ],
        "named": [
            {"name": "inner", "use": "plan:rich"},
            {"name": "with_nation", "use": "join", "inputs": {"right": "nation"},
             "options": {"on": "nation", "columns": "n_name"}},
        ],
    }
    nation = table(s, d, "nation").withColumnRenamed("n_nationkey", "nation")
    customer = table(s, d, "customer").withColumnRenamed("c_nationkey", "nation")
    out = compose.run_plan(
        [
            {"name": "named", "use": "plan:named"},
            {"name": "sum", "use": "summarise",
             "options": {"group_by": "n_name", "measures": {"c_acctbal": "sum"}}},
        ],
        customer, tables={"nation": nation}, plans=plans,
    )["sum"]
    return out.withColumn("c_acctbal_sum", F.round("c_acctbal_sum", 2))


@C.add("observed_run", """SELECT 'flags' AS step, 'succeeded' AS status, count(DISTINCT l_returnflag) AS rows FROM lineitem
       UNION ALL SELECT 'taxed', 'succeeded', count(*) FROM lineitem WHERE l_quantity > 40""")
def _(s, d):
    """Rows per written output; the seconds are left out, as they differ by run."""
    spec = [
        {"name": "big", "use": "filter_rows", "options": {"column": "l_quantity", "op": "gt", "value": 40}},
        {"name": "flags", "use": "value_counts", "options": {"column": "l_returnflag"}},
        {"name": "taxed", "use": "formula", "reads": "big",
         "options": {"expressions": {"tax": "l_extendedprice * l_tax"}}},
    ]
    out = runs.run_observed(
        spec, table(s, d, "lineitem"), lambda _n, df: df.write.format("noop").mode("overwrite").save()
    )
    return out.drop("seconds")


def _trials(s, d):
    """A run per customer and order date: its experiment the segment, its trial the nation."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        "c_mktsegment", F.concat(F.lit("t"), "c_nationkey").alias("trial"), "o_orderdate", "o_orderkey",
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("accuracy"),
    )


_TRIALS = """t AS (SELECT c_mktsegment, concat('t', c_nationkey) AS trial, o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS accuracy,
    row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders JOIN customer ON o_custkey = c_custkey)"""


@C.add("leaderboard", f"""WITH {_TRIALS} SELECT c_mktsegment, trial, accuracy AS primary_value, row_number() OVER (PARTITION BY c_mktsegment
       ORDER BY accuracy DESC NULLS LAST, trial) AS place FROM t WHERE n = 1""")
def _(s, d):
    out = runs.leaderboard(
        _trials(s, d), experiment="c_mktsegment", trial="trial", primary="accuracy",
        order_by="o_orderdate,o_orderkey",
    )
    return out.select("c_mktsegment", "trial", "primary_value", "place")


@C.add("compare_runs", """WITH w AS (SELECT o_orderpriority AS experiment, year(o_orderdate) AS trial, max(o_totalprice) AS largest, min(o_totalprice) AS least
         FROM orders GROUP BY ALL)
       SELECT experiment, trial, largest, least, row_number() OVER (ORDER BY largest DESC, experiment, trial) AS place FROM w""")
def _(s, d):
    o = table(s, d, "orders").groupBy(
        F.col("o_orderpriority").alias("experiment"), F.year("o_orderdate").cast("long").alias("trial")
    ).agg(F.max("o_totalprice").alias("largest"), F.min("o_totalprice").alias("least"))
    long = o.unpivot(["experiment", "trial"], ["largest", "least"], "metric", "value")
    return runs.compare_runs(
        long, experiment="experiment", trial="trial", metric="metric", value="value", shared="largest"
    )


@C.add("check_target", f"""WITH {_TRIALS} SELECT c_mktsegment, trial, CASE WHEN accuracy IS NULL THEN 'unknown'
       WHEN accuracy >= 150000 AND accuracy <= 400000 THEN 'pass' ELSE 'fail' END AS verdict FROM t WHERE n = 1""")
def _(s, d):
    latest = runs.latest_runs(_trials(s, d), trial="c_mktsegment,trial", order_by="o_orderdate,o_orderkey")
    return runs.check_target(latest, metric="accuracy", least=150000, most=400000).select(
        "c_mktsegment", "trial", "verdict"
    )


EDGES = """e AS (SELECT concat('r', r_regionkey) AS source, concat('n', n_nationkey) AS target FROM region JOIN nation ON r_regionkey = n_regionkey
    UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer
    UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM orders)"""


def edges(s, d):
    def part(df, a, x, b, y):
        return df.select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"))

    return (
        part(table(s, d, "nation"), "r", "n_regionkey", "n", "n_nationkey")
        .unionByName(part(table(s, d, "customer"), "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(part(table(s, d, "orders"), "c", "o_custkey", "o", "o_orderkey"))
    )


@C.add("lineage_down", f"""WITH RECURSIVE {EDGES}, w AS (SELECT 'r1' AS node, CAST(0 AS INTEGER) AS hop UNION SELECT target, hop + 1 FROM w JOIN e ON source = node WHERE hop < 4)
       SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node""")
def _(s, d):
    roots = s.createDataFrame([("r1",)], "node string")
    return lineage.walk(edges(s, d), roots, depth=4)[0]


@C.add("lineage_up", f"""WITH RECURSIVE {EDGES}, w AS (SELECT concat('o', o_orderkey) AS node, CAST(0 AS INTEGER) AS hop FROM orders
         UNION SELECT source, hop + 1 FROM w JOIN e ON target = node WHERE hop < 2)
       SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node""")
def _(s, d):
    roots = table(s, d, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("node")
    )
    return lineage.walk(edges(s, d), roots, direction="up", depth=2)[0]
