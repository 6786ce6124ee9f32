"""Rows and rules that fail, limits that were not asked for, and writers that died."""

import pytest
from pyspark.sql import functions as F

from fathomline.condition.findings import rule_findings
from fathomline.models import evidence
from fathomline.operators import aggregate, charts, rows
from fathomline.sources.versions import Datasets


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame([(1, 4.0, 2.0, "7"), (2, 4.0, 0.0, "x"), (3, None, 1.0, None)], "id long, x double, z double, t string")


def test_failing_rows_are_null(numbers):
    out = rows.formula(numbers, expressions={"r": "x / z", "n": "cast(t as int)"})
    assert [(o["r"], o["n"]) for o in out.orderBy("id").collect()] == [(2.0, 7), (None, None), (None, None)]
    failed = rows.formula_failures(out, outputs="r", inputs="x,z").first()
    assert (failed["rows"], failed["failed_r"]) == (3, 1)
    assert out.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"


def test_failing_rules_do_not_match(numbers):
    out = rows.rule(numbers, rules=[{"name": "a", "when": "x / z > 1", "then": {"k": 1}}], default={"k": 0})
    assert [o["k"] for o in out.orderBy("id").collect()] == [1, 0, 0]


@pytest.mark.parametrize("condition,fires", [
    ("case when x > 1 then true else false end", 2), ("x > 1e-3", 2), ("cast(x as int) > 1", 2), ("x / z > 1", 1),
    ("missing > 1", 0), ("x >", 0), ("", 0), ("cast(t as int) = 7", 1),
])
def test_engineering_rules(spark, numbers, condition, fires):
    record = numbers.select(F.col("id").alias("asset_id"), F.lit("2024-01-01").alias("as_of"), F.lit("pump").alias("asset_type"), "x", "z", "t")
    kinds = "name string, when string, finding string, asset_type string, weight double, confidence double, failure_mode string, recommended_action string"
    rules = spark.createDataFrame([("r", condition, "f", "*", 1.0, None, None, None)], kinds)
    assert rule_findings(record, rules).count() == fires


def test_nothing_is_cut_unasked(spark):
    many = spark.range(700).withColumn("y", F.col("id") * 1.0)
    assert aggregate.value_counts(many, column="id").count() == 700
    assert charts.plain_series(many, x="id", y="y", order_by="id").count() == 700
    assert rows.explore_query(many, sort_by="id", limit=6000).count() == 700
    with pytest.raises(ValueError):
        rows.explore_query(many, offset=5)
    found = evidence.evidence_bundle(many.withColumn("s", F.lit("a")), subject="s", severity="y", order_by="id")
    assert found.count() == 700


def test_references_are_exact(spark):
    bundle = spark.createDataFrame([("a", 1), ("a", 2)], "s string, place int")
    said = spark.createDataFrame([("a", "[E1] [E2] [E01] [E3] [E0] [E99999999999999999999]")], "s string, text string")
    got = evidence.unsupported_citations(said, bundle, subject="s", text="text").first()["unsupported"]
    assert got == ["E0", "E01", "E3", "E99999999999999999999"]


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    store = Datasets(spark, str(tmp_path))
    assert store.write(spark.range(3), "d") == 1
    spark.range(5).write.parquet(store.path("d", 2))  # written, never listed
    assert store.write(spark.range(4), "d") == 3 and store.read("d").count() == 4
    with pytest.raises(ValueError):
        store.write(spark.range(1), "_versions")
