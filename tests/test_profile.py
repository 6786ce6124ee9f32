"""The column profile: figures against plain aggregates, awkward columns, the hot path, one scan."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators.aggregate import profile


def by_column(df, **options):
    return {r["column"]: r.asDict(recursive=True) for r in profile(df, **options).collect()}


@pytest.mark.parametrize("blocks", [False, True])
def test_awkward_columns(spark, blocks):
    df = spark.sql("""SELECT * FROM VALUES
        (1, 'b', 0.0D, true, array(1, 2), 1000000.1D, cast(null as string), timestamp'2024-01-01 00:00:00'),
        (2, 'a', -0.0D, false, array(1, 2), 1000000.2D, null, timestamp'2024-01-01 00:00:00'),
        (2, 'b', null, true, null, 1000000.3D, null, null),
        (null, 'a', double('NaN'), null, array(), 1000000.4D, null, timestamp'2024-01-02 00:00:00')
        t(n, s, z, b, l, big, nothing, at)""")
    got = by_column(df, blocks=blocks)
    assert list(got) == df.columns
    assert (got["n"]["count"], got["n"]["null_count"], got["n"]["null_ratio"]) == (4, 1, 0.25)
    assert (got["n"]["distinct_count"], got["n"]["median"], got["n"]["top_values"]) == (2, 2.0, None)
    assert got["s"]["top_values"] == [{"value": "a", "count": 2}, {"value": "b", "count": 2}]
    assert got["s"]["min"] is None and got["s"]["stddev"] is None
    assert got["z"]["distinct_count"] == df.select(F.count_distinct("z")).first()[0] == 2
    assert got["l"]["top_values"] == [{"value": "[1, 2]", "count": 2}, {"value": "[]", "count": 1}]
    assert got["big"]["stddev"] == round(df.select(F.stddev_samp("big")).first()[0], 6)
    assert (got["nothing"]["distinct_count"], got["nothing"]["null_ratio"], got["nothing"]["top_values"]) == (0, 1.0, None)
    assert got["at"]["distinct_count"] == 2


def test_empty_and_limits(spark):
    df = spark.createDataFrame([(str(i % 20), float(i)) for i in range(50)], "s string, v double")
    got = by_column(df.limit(0))
    assert [(c, r["count"], r["null_ratio"], r["distinct_count"]) for c, r in got.items()] == [("s", 0, 0.0, 0), ("v", 0, 0.0, 0)]
    words = df.withColumn("s", F.concat(F.lit("w"), "s"))
    assert len(by_column(words)["s"]["top_values"]) == 12
    assert [t["value"] for t in by_column(words, top=2)["s"]["top_values"]] == ["w0", "w1"]
    sketched = by_column(words, exact=False)
    assert sketched["s"]["distinct_count"] == 20 and sketched["v"]["mean"] == 24.5 and sketched["s"]["top_values"] is None


def test_hot_equals_plain(spark, folder, hot):
    events = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_type", "value", "ts")
    assert by_column(events) == by_column(events, blocks=False)


def test_one_scan(spark, folder):
    out = profile(spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_type", "value"), blocks=False)
    plan = out._jdf.queryExecution().executedPlan()
    spark._jvm.org.apache.spark.sql.execution.SparkPlan  # the class the plan belongs to
    plan.executeCollect()
    final = plan.toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
