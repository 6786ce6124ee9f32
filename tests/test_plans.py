import json

import pytest

from fathomline.operators import aggregate as A
from fathomline.operators import rows as R
from fathomline.operators import windows as W
from fathomline.plans.compose import StepFailed, run_plan, steps_from_query
from fathomline.plans.registry import REGISTRY, lookup
from fathomline.sources import readers
from fathomline.streaming.resample import resample_stream


@pytest.fixture(scope="module")
def orders(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet")


def step(name, use, options=None, **more):
    return {"name": name, "use": use, "options": options or {}, **more}


def test_bad_plans_are_refused_before_anything_runs(orders):
    cases = [
        ([step("a", "drop_columns", {"columns": "x"})] * 2, "unique names"),
        ([step("a", "drop_columns", {"columns": "x"}, reads="b")], "does not exist"),
        ([step("a", "drop_columns", {"columns": "x"}, reads="b"),
          step("b", "drop_columns", {"columns": "x"}, reads="a")], "circle"),
        ([step("a", "no_such")], "no operator"),
        ([step("a", "drop_columns", {"column": "x"})], "no option"),
        ([step("a", "drop_columns")], "needs"),
    ]
    for spec, message in cases:
        with pytest.raises(ValueError, match=message):
            run_plan(spec, orders)


def test_models_check_what_they_are_given(orders):
    cases = [
        ([step("a", "train_model", {"algorithm": 3, "target": "x", "features": "y"})], "other types"),
        ([step("a", "limit_rows", {"count": True, "order_by": "o_orderkey"})], "other types"),
        ([step("a", "train_model", {"algorithm": "ridge", "target": "nothing", "features": "o_totalprice"})], "nothing"),
        ([step("a", "apply_model")], "missing"),
        ([step("a", "vote", {"key": "k", "label": "l"}, inputs={"wrong": "t"})], "unknown"),
        ([step("a", "nearest", {"key": "o_orderkey", "vector": "absent"}, inputs={"items": "t"})], "absent"),
    ]
    for spec, message in cases:
        with pytest.raises(ValueError, match=message):
            run_plan(spec, orders, tables={"t": orders})
    twice = orders.sparkSession.createDataFrame([("a", ["x"]), ("b", ["x"])], "model string, features array<string>")
    with pytest.raises(ValueError, match="one row"):
        run_plan([step("a", "apply_model", inputs={"trained": "t"})], orders, tables={"t": twice})


def test_tracks_in_a_plan(spark):
    points = spark.createDataFrame(
        [(k, i, 20.0 + i + n, 120.0 + i) for n, k in enumerate("abc") for i in range(5)],
        "track string, i int, y double, x double",
    )
    spec = [step("near", "path_distance", {"track": "track", "order_by": "i", "k": 2}, inputs={"tracks": "all"})]
    out = run_plan(spec, points, tables={"all": points})["near"]
    assert out.count() == 6


def test_condition_in_a_plan(spark, folder):
    from fathomline.catalog import condition as C

    f = C.fleet(spark, folder)
    tables = {n: getattr(f, n) for n in ("assets", "maintenance", "failures", "policies", "modes", "rules", "quality")}
    spec = [step("decided", "maintenance_decisions", {"moments": C.MOMENTS[:1], "under": ["full"]}, inputs={n: n for n in tables}),
            step("summary", "fleet_summary")]
    row = run_plan(spec, f.features, tables=tables)["summary"].first()
    assert row["policy"] == "full" and row["assets"] > 0


def test_outputs_branches_and_nesting(orders):
    spec = [
        step("open", "filter_rows", {"column": "o_orderstatus", "op": "equals", "value": "O"}, materialise=True),
        step("counts", "value_counts", {"column": "o_orderpriority"}),
        step("top", "top_per_group", {"k": 2, "order_by": "-o_totalprice"}, reads="open"),
    ]
    out = run_plan(spec, orders)
    assert set(out) == {"open", "counts", "top"} and out["top"].count() == 2
    loop = {"x": [step("again", "plan:x")]}
    with pytest.raises(StepFailed, match="contains itself"):
        run_plan([step("x", "plan:x")], orders, plans=loop)


def test_a_failing_step_is_named(orders):
    with pytest.raises(StepFailed) as caught:
        run_plan([step("good", "drop_columns", {"columns": "o_custkey"}),
                  step("bad", "select_columns", {"columns": "o_custkey"})], orders)
    assert caught.value.step == "bad"


def test_query_steps_refuse_contains():
    with pytest.raises(ValueError, match="contains"):
        steps_from_query(conditions=[{"column": "a", "op": "contains", "value": "x"}])


def test_registry_knows_its_operators():
    assert len(REGISTRY) >= 70
    assert "order_by" in lookup("rolling_stats").options and lookup("join").inputs == ("left", "right")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, folder, orders):
    out = R.select_columns(
        R.filter_rows(R.filter_rows(orders, column="o_totalprice", op="gt", value=1000),
                      column="o_orderstatus", op="equals", value="O"), columns="o_orderkey")
    text = plan_of(out)
    assert "GreaterThan(o_totalprice,1000.0)" in text and "EqualTo" in text
    assert "o_custkey" not in text.split("ReadSchema")[1]


def test_no_global_operator_gathers_all_rows(orders):
    slim = orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    for df in (
        R.rank_rows(slim, column="o_totalprice", order_by="o_orderkey"),
        W.moving_average(slim, column="o_totalprice", order_by="o_orderkey"),
        W.lag_column(slim, column="o_totalprice", order_by="o_orderkey"),
        A.percent_of_total(slim, column="o_totalprice"),
    ):
        outer = plan_of(df).split("Subquery")[0]
        assert "SinglePartition" not in outer


def test_inline_rows_and_contracts(spark):
    df = readers.inline_rows(spark, [{"a": 1, "b": "x"}, {"a": 2.5, "c": {"k": [1]}}, {"b": 3}])
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert [r["b"] for r in df.collect()] == ["x", None, "3"]
    with pytest.raises(ValueError, match="row 1"):
        readers.inline_rows(spark, [{}, 5])
    found = readers.check_contract(df, [{"name": "a", "type": "integer"}, {"name": "b", "type": "timestamp"}, {"name": "z"}])
    assert found == {"errors": ["column 'z' is missing"], "warnings": ["column 'b' is string, wanted timestamp"]}


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"data": {"rows": [{"a": 1, "n": {"x": 2}}, {"a": 3}]}}))
    df = readers.read_uri(spark, str(tmp_path / "d.json"), records_path="data.rows")
    assert sorted(r["a"] for r in df.collect()) == [1, 3]
    assert dict(readers.flatten_nested(df).dtypes)["n"] == "string"
    with pytest.raises(ValueError, match="nothing at"):
        readers.read_uri(spark, str(tmp_path / "d.json"), records_path="data.none")
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    assert readers.read_uri(spark, str(tmp_path / "t.tsv"), limit=1).count() == 1
    with pytest.raises(ValueError, match="no reader"):
        readers.read_uri(spark, "x.xlsx")


def test_database_options():
    with pytest.raises(ValueError):
        readers.database_options("jdbc:x", table="t", query="q")
    got = readers.database_options("jdbc:x", query="select 1", partition={"column": "id", "lower": 0, "upper": 9, "parts": 3})
    assert got["dbtable"] == "(select 1) q" and got["numPartitions"] == "3"


def test_stream_closes_periods(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0), ("2024-01-01 01:10:00", 5.0), ("2024-01-01 05:00:00", 9.0)]
    spark.createDataFrame(rows, "ts string, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts string, v double").parquet(str(tmp_path / "in"))
    out = resample_stream(source, timestamp="ts", measures={"v": ["mean", "count"]})
    query = out.writeStream.outputMode("append").format("memory").queryName("closed").start()
    query.processAllAvailable()
    query.stop()
    got = {r["period"]: (r["v_mean"], r["sample_count"]) for r in spark.table("closed").collect()}
    assert got == {"2024-01-01 00:00:00": (2.0, 2), "2024-01-01 01:00:00": (5.0, 1)}
