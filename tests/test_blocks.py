"""The layouts for hot groups give what the plain windows give."""

import pytest
from pyspark.sql import Window, functions as F

from fathomline.operators.joins import look_ahead
from fathomline.operators.rows import explore_query, page
from fathomline.operators.ordered import lay_out, over_present, over_rows, position, running_sum
from fathomline.operators import quantiles as quantile_rounds
from fathomline.operators.quantiles import quantiles
from fathomline.operators.aggregate import summarise
from fathomline.operators.windows import half_drift, longest_runs, rolling_stats
from fathomline.models.quality import data_quality


@pytest.fixture
def events(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", "ts", "value",
        F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type")).alias("g"),
        F.when(~F.col("event_type").isin("error", "view"), F.col("value")).alias("v"),
    )


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    rounded = [
        F.round(c, 6).alias(c) if dict(a.dtypes)[c] == "double" else F.col(c) for c in columns
    ]
    x, y = a.select(rounded), b.select(rounded)
    assert a.count() == b.count()
    assert x.exceptAll(y).count() == 0


GROUPS = (["g"], [])


@pytest.mark.parametrize("groups", GROUPS)
def test_frames_and_lags(events, hot, groups):
    def out(w):
        return {"a": F.lag("value", 2).over(w), "b": F.lead("value").over(w),
                "c": F.sum("value").over(w.rowsBetween(-4, 0))}

    w = Window.partitionBy(*groups).orderBy("ts", "event_id")
    got = over_rows(events, out, group_by=groups, order_by="ts,event_id", before=4, after=1)
    same(got, events.withColumns(out(w)))


@pytest.mark.parametrize("groups", GROUPS)
def test_positions(events, hot, groups):
    w = Window.partitionBy(*groups).orderBy("ts", "event_id")
    got = position(events, "n", group_by=groups, order_by="ts,event_id")
    same(got, events.withColumn("n", F.row_number().over(w).cast("long")))


@pytest.mark.parametrize("groups", GROUPS)
def test_present_values(events, hot, groups):
    def out(w):
        return {"m": F.avg("_v").over(w), "held": F.size(F.collect_list("_v").over(w))}

    w = Window.partitionBy(*groups).orderBy("ts", "event_id")
    k = events.withColumn("_v", F.col("v")).withColumn(
        "_k", F.count("v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    plain = k.withColumns(out(Window.partitionBy(*groups).orderBy("_k").rangeBetween(-4, 0)))
    got = over_present(events, F.col("v"), out, window=5, group_by=groups, order_by="ts,event_id")
    same(got, plain.drop("_v", "_k"))


@pytest.mark.parametrize("groups", GROUPS)
def test_running_sum(events, hot, groups):
    w = Window.partitionBy(*groups).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    got = running_sum(events, F.col("value"), "s", group_by=groups, order_by="ts,event_id")
    same(got, events.withColumn("s", F.sum("value").over(w)))


@pytest.mark.parametrize("groups", GROUPS)
def test_quantiles(events, hot, groups):
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    wanted = F.percentile("v", F.array(*[F.lit(x) for x in p]))
    plain = events.groupBy(*groups).agg(wanted.alias("q"))
    got = quantiles(events, F.col("v"), p, group_by=groups, output="q")

    def rows(df):
        return sorted(
            (tuple(r[g] for g in groups), None if r["q"] is None else [round(x, 6) for x in r["q"]])
            for r in df.collect()
        )

    assert rows(got) == rows(plain)


def test_quantiles_brackets(spark):
    """Groups too large for the whole-group bracket, with a value held by a third of the rows."""
    df = spark.range(200_000).select(
        (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.xxhash64("id") % 100_003).cast("double")).alias("v"),
    )
    p = [0.05, 0.25, 0.5, 0.75, 0.95]
    plain = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(x) for x in p])).alias("q"))
    got = quantiles(df, F.col("v"), p, group_by="g", output="q", blocks=True)
    assert sorted((r["g"], [round(x, 6) for x in r["q"]]) for r in got.collect()) == sorted(
        (r["g"], [round(x, 6) for x in r["q"]]) for r in plain.collect()
    )


@pytest.mark.parametrize("groups", GROUPS)
def test_quantiles_rounds(spark, monkeypatch, groups):
    """Brackets cut again and again: ties, a third of equal values, lone far values, unsorted probabilities."""
    monkeypatch.setattr(quantile_rounds, "_ACCURACY", 200)
    monkeypatch.setattr(quantile_rounds, "_STEPS", 20)
    monkeypatch.setattr(quantile_rounds, "HOT_ROWS", ("fathomline.none", "1"))
    rounds = []
    cut = quantile_rounds._cut
    monkeypatch.setattr(quantile_rounds, "_cut", lambda *a: rounds.append(1) or cut(*a))
    df = spark.range(120_000).select(
        F.when(F.col("id") % 1000 == 0, "small").when(F.col("id") % 1000 == 1, None).otherwise("large").alias("g"),
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 50_000 == 1, 1e300).when(F.col("id") % 7 == 0, None)
        .otherwise(F.exp((F.xxhash64("id") % 90_007) / 1000.0)).alias("v"),
    )
    p = [0.5, 0.0, 0.25, 0.9, 0.37, 0.371, 1.0]
    plain = df.groupBy(*groups).agg(F.percentile("v", F.array(*[F.lit(x) for x in p])).alias("q"))
    got = quantiles(df, F.col("v"), p, group_by=groups, output="q", blocks=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert rounds
    shown = got._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in shown.split("\n") if " Window " in x]
    assert windows and all("[i#" in x or ", i#" in x for x in windows)


def test_quantiles_missed_bracket(spark, monkeypatch):
    from pyspark.errors import PySparkException

    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    wrong = df.agg(F.count("v").alias("_n"), F.array(F.lit(900.0)).alias("_lo"), F.array(F.lit(950.0)).alias("_hi"))
    monkeypatch.setattr(quantile_rounds, "_brackets", lambda *a: wrong)
    with pytest.raises(PySparkException, match="bracket"):
        quantiles(df, F.col("v"), [0.5], blocks=True).collect()


def test_quantiles_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles(df, F.col("v"), [0.5], blocks=True).first()["quantiles"] is None
    assert quantiles(df.limit(0), F.col("v"), [0.5], blocks=True).first()["quantiles"] is None


@pytest.mark.parametrize("key", ["one", None, "g"])
def test_look_ahead(events, hot, key):
    """One key for all rows, in blocks of seven: rows at the moment of an event, no events for long, null keys."""
    k = F.col("g") if key == "g" else F.lit(key).cast("string")
    rows = events.select("event_id", "ts", F.when(F.col("event_id") % 11 > 0, k).alias("k"))
    rows = rows.withColumn("ts", F.when(F.col("event_id") % 50 > 0, F.date_trunc("hour", "ts")))
    happened = rows.where("event_id % 40 = 3").unionByName(rows.where("event_id % 80 = 3"))
    for horizon in (3600, 86_400, 10_000_000):
        args = dict(keys="k", time="ts", event_time="ts", horizon_seconds=horizon)
        got = look_ahead(rows, happened, **args)
        same(got, look_ahead(rows, happened, blocks=False, **args))
        pairs = rows.alias("a").join(happened.alias("b"), F.expr(
            f"a.k <=> b.k AND b.ts > a.ts AND unix_micros(b.ts) - unix_micros(a.ts) <= {horizon}000000L"), "left")
        brute = pairs.groupBy("a.event_id").agg(F.min((F.unix_micros("b.ts") - F.unix_micros("a.ts")) / 1e6).alias("lead_seconds"))
        same(got.select("event_id", "lead_seconds"), brute)
    assert got.where("lead_seconds IS NOT NULL").count() > 100


def test_deep_pages(events, hot):
    order = ["-value", "event_id"]
    every = [r["event_id"] for r in events.orderBy(F.desc_nulls_last("value"), "event_id").collect()]
    n = len(every)
    for offset, length in ((0, 3), (0, n), (n // 2, 10), (n - 3, 50), (n + 5, 10), (5, 0)):
        got = page(events, offset=offset, length=length, order_by=order)
        assert [r["event_id"] for r in got.collect()] == every[offset:offset + length]
    deep = page(events, offset=n // 2, length=10, order_by=order)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in deep and "GlobalLimit" not in deep and "GreaterThanOrEqual(_row" in deep
    up = explore_query(events, columns="event_id", sort_by=["value", "-event_id"], descending=True, offset=50, limit=20)
    assert [r[0] for r in up.collect()] == every[50:70] and up.columns == ["event_id"]
    assert page(events.limit(0), offset=500, length=5, order_by=order).count() == 0


def test_equal_order_values_spread(spark):
    """Rows that an order cannot tell apart still fall into several ranges."""
    df = spark.range(0, 40_000, 1, 8).select("id", F.lit(1).alias("t"), F.create_map("id", "id").alias("m"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = lay_out(df, [], ["t"]).rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = rows.groupBy(F.shiftrightunsigned("_row", 33).alias("p")).count().collect()
    assert len(held) >= 6 and max(r["count"] for r in held) < 12_000
    assert rows.select("_idx").distinct().count() == 40_000


def test_composed_operators(events, spark, hot):
    coarse = events.withColumn("v", F.floor(F.col("v") / 50) * 50.0)
    calls = [
        lambda b: rolling_stats(coarse, column="v", window=4, group_by="g", order_by="ts,event_id",
                                statistics="mean,median,zscore,slope,r_squared", blocks=b),
        lambda b: longest_runs(coarse, column="v", group_by="g", order_by="ts,event_id", blocks=b),
        lambda b: half_drift(coarse, column="v", group_by="g", order_by="ts,event_id", blocks=b),
        lambda b: summarise(events, group_by="g", measures={"v": "median"}, blocks=b),
        lambda b: data_quality(coarse, value="v", timestamp="ts", group_by="g", tie_break="event_id",
                               expected_interval_minutes=60, blocks=b),
    ]
    for call in calls:
        same(call(True), call(False))
