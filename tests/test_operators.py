"""Awkward values with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import aggregate as A
from fathomline.operators import charts, joins, reshape
from fathomline.operators import rows as R
from fathomline.operators import windows as W


@pytest.fixture(scope="module")
def storms(spark):
    return spark.createDataFrame(
        [
            (1, "Ada", 30, "1,013", "2001-08-03 10:00:00", "2001-08-05", "12.5 mm", " "),
            (2, "Bo", None, "no data", "2001/08/04", None, "-", "x"),
            (3, "Ada", 30, "980 hPa", "not a date", "2001-08-01", None, None),
            (4, None, 45, "-3.5", "2001-08-03T11:30:00", "2001-08-03", "1,200", "y"),
        ],
        "id int, name string, wind int, pressure string, formed string, ended string, rain string, note string",
    )


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_numbers_out_of_text(storms):
    out = R.parse_numeric(storms, column="pressure")
    assert column(out, "pressure_value") == [1013.0, None, 980.0, -3.5]
    cast = R.cast_types(storms, casts={"pressure": "number", "wind": "text", "note": "boolean"})
    assert column(cast, "pressure") == [1013.0, None, None, -3.5]
    assert column(cast, "note") == [None, False, None, True]
    assert cast.columns == storms.columns


def test_equality_compares_printed_values(storms):
    assert column(R.filter_rows(storms, column="name", op="not_equals", value="Ada"), "id") == [2, 4]
    assert column(R.filter_rows(storms, column="wind", op="equals", value="30"), "id") == [1, 3]
    assert column(R.filter_rows(storms, column="wind", op="in", value=["45", "None"]), "id") == [2, 4]
    # Text never satisfies an ordering here.
    assert R.filter_rows(storms, column="pressure", op="gt", value=0).count() == 0
    with pytest.raises(ValueError, match="leaves no row"):
        R.filter_rows(storms, column="wind", op="gt", value=99, require_rows=True)


def test_explore_conditions(storms):
    def ids(*conditions):
        return column(R.explore_filter(storms, conditions=list(conditions)), "id")

    assert ids({"column": "wind", "op": "gte", "value": "30.0"}) == [1, 3, 4]
    assert ids({"column": "wind", "op": "ne", "value": 30}) == [4]
    assert ids({"column": "name", "op": "contains", "value": "AD"}) == [1, 3]
    assert ids({"column": "name", "op": "is_null"}) == [4]
    assert ids({"column": "wind", "op": "in", "value": []}) == []


def test_flags_fill_and_maps(storms):
    assert column(R.flag_rows(storms, column="note"), "note_flag") == [False, True, False, True]
    assert column(R.flag_rows(storms, column="pressure", op="gt", value=100), "pressure_flag") == [
        True, False, False, False]
    assert column(R.fill_missing(storms, columns="note,wind", value=0), "note") == ["0", "x", "0", "y"]
    mapped = R.map_values(storms, column="name", mapping={"Ada": "A", "": "none"})
    assert column(mapped, "name_label") == ["A", "Bo", "A", "none"]


def test_moments(storms):
    parts = R.datetime_parts(storms, column="formed", parts="day,hour,date", prefix="f")
    assert column(parts, "f_day") == [3, 4, None, 3]
    assert column(parts, "f_hour") == [10, 0, None, 11]
    spans = R.duration_between(storms, start="formed", end="ended", unit="hours", output="h")
    assert column(spans, "h") == [38.0, None, None, None]


def test_band_edges_land_once(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-1.0, 0.0, 10.0, 20.0, 20.5, None])], "id int, v double")
    out = R.bin_numeric(df, column="v", edges=[0, 10, 20])
    assert column(out, "v_band") == ["below range", "0-10", "10-20", "10-20", "above range", None]
    with pytest.raises(ValueError):
        R.bin_numeric(df, column="v", edges=[3, 1])


def test_rules_do_not_match_on_errors(storms):
    rules = [{"name": "a", "when": "try_divide(wind, id - 1) > 20", "then": {"k": 1}},
             {"name": "b", "when": "wind >= 30", "then": {"k": 2, "z": "t"}}]
    first = R.rule(storms, rules=rules, default={"k": 0})
    assert column(first, "k") == [2, 0, 2, 2]
    both = R.rule(storms.withColumn("wind", F.lit(50)), rules=rules, mode="all_matches")
    assert column(both, "k") == [2, 2, 2, 2]
    assert column(both, "matched_rules") == [["b"], ["a", "b"], ["a", "b"], ["b"]]


def test_order_and_duplicates(storms):
    assert [r["id"] for r in R.sort_rows(storms, column="-wind,id").collect()] == [4, 1, 3, 2]
    assert column(R.drop_duplicates(storms, columns="name,wind", order_by="id"), "id") == [1, 2, 4]
    assert [r["id"] for r in R.limit_rows(storms, count=2, from_end=True, order_by="id").collect()] == [3, 4]
    ranked = R.rank_rows(storms, column="wind", order_by="id")
    assert column(ranked, "wind_rank") == [2, None, 3, 1]
    with pytest.raises(ValueError, match="order_by"):
        R.limit_rows(storms, count=1, order_by=None)


def test_joins_name_what_is_missing(storms):
    right = storms.select(F.col("id").cast("string").alias("id"), "name")
    out = joins.join(storms, right, on="id")
    assert "name_right" in out.columns and out.count() == 4
    with pytest.raises(ValueError, match="right table has no"):
        joins.join(storms, right, on="wind")
    with pytest.raises(ValueError, match="left table has no"):
        joins.join(storms.drop("id"), right, on="id")


@pytest.fixture(scope="module")
def readings(spark):
    rows = []
    for i in range(8):
        rows.append((f"2024-01-01 {i:02d}:00:00", "fast", 10.0 + 2.0 * i))
        rows.append((f"2024-01-01 {3 * i % 24:02d}:00:00" if i < 8 else "", "slow", 5.0 + 2.0 * (3 * i)))
        rows.append((f"2024-01-01 {i:02d}:00:00", "flat", 4.0))
    return spark.createDataFrame(rows, "ts string, unit string, value double")


def test_slopes_are_per_time_not_per_sample(readings):
    out = {r["unit"]: r for r in A.linear_trend(
        readings, column="value", group_by="unit", order_by="ts", per="hour").collect()}
    assert out["fast"]["value_slope_per_hour"] == out["slow"]["value_slope_per_hour"] == 2.0
    assert out["flat"]["value_r_squared"] is None
    assert out["flat"]["value_direction"] == "stable"
    assert out["fast"]["value_direction"] == "increasing"


def test_correlation_of_a_flat_column_is_null(readings):
    df = readings.withColumn("same", F.lit(1.0))
    row = A.correlation(df, columns="value,same").first()
    assert row["correlation"] is None and row["points"] == 24


def test_windows_skip_missing_readings(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, None, 3.0, 5.0, None])], "id int, v double")
    out = W.rolling_stats(df.withColumn("g", F.lit(1)), column="v", window=2, group_by="g", order_by="id",
                          statistics="mean,count", min_periods=1)
    assert column(out, "v_roll_mean2") == [1.0, 1.0, 2.0, 4.0, 4.0]
    assert column(W.moving_average(df, column="v", window=2, order_by="id"), "v_ma2") == [1.0, 1.0, 2.0, 4.0, 4.0]


def test_runs_across_a_gap(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, None, 5.0, 5.0, 6.0])], "id int, v double")
    assert W.longest_runs(df.withColumn("g", F.lit(1)), column="v", group_by="g", order_by="id").first()[1] == 3


def test_reshape(readings, spark):
    wide = reshape.pivot_wider(readings, keys="ts", name_from="unit", value_from="value", order_by="ts,unit")
    assert wide.columns == ["ts", "fast", "flat", "slow"]
    back = reshape.unpivot_longer(wide, keys="ts", name_to="unit")
    assert back.count() == readings.select("ts", "unit").distinct().count()
    with pytest.raises(ValueError):
        reshape.resample_time(readings, timestamp="ts", period="decade", measures={"value": "mean"})
    unread = readings.withColumn("ts", F.when(F.col("unit") != "flat", F.col("ts")).otherwise("soon"))
    day = reshape.resample_time(unread, timestamp="ts", measures={"value": "count"}).first()
    assert day["sample_count"] == 16


def test_constant_histogram_has_one_bucket(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    rows = charts.histogram(df, column="v").collect()
    assert [(r["bucket"], r["count"]) for r in rows] == [(0, 4)]


def test_a_missing_position_has_no_distance(spark):
    from fathomline.functions.geo import great_circle_km

    df = spark.createDataFrame([(0.0, None), (0.0, 180.0)], "a double, b double")
    zero = F.lit(0.0)
    got = [r[0] for r in df.select(great_circle_km(zero, zero, F.col("a"), F.col("b"))).collect()]
    assert got[0] is None and round(got[1]) == 20015


def test_arc_points_are_evenly_spaced(spark):
    df = spark.createDataFrame([("t", i, 0.0, float(x)) for i, x in enumerate([0, 1, 4, 10])],
                               "track string, i int, lat double, lon double")
    out = W.arc_points(df, track="track", order_by="i", points=11, values=[]).orderBy("step").collect()
    assert [round(r["lon"], 6) for r in out] == [float(i) for i in range(11)]
