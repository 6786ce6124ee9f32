"""The latest rows at moments, and trends over one ordering a column."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fathomline.condition.features import SERIES, trends
from fathomline.operators.joins import as_of
from fathomline.operators.windows import rolling_stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_cuts_rows_before_they_travel(spark):
    """Rows that no moment asks for are cut before the shuffle; ties, nulls and moments out of order as before."""
    dice, start = random.Random(7), datetime(2024, 1, 1)
    rows = [
        (dice.choice(["a", "b", None]), dice.choice([None, *(start + timedelta(days=k) for k in range(20))]), dice.choice([None, 1, 2, 3]), i)
        for i in range(300)
    ]
    # Of rows that agree in key, time and tie-breaker any may be taken: keep one.
    rows = list({r[:3]: r for r in rows}.values())
    moments = ["2024-01-15 12:00:00", "2023-12-31 00:00:00", "2024-01-05 00:00:00", "2024-02-01 00:00:00"]
    df = spark.createDataFrame(rows, "k string, at timestamp, tie int, i int")
    out = as_of(df, keys="k", time="at", moments=moments, tie_break="tie")
    expected = set()
    for m in moments:
        moment = datetime.fromisoformat(m)
        for key in {r[0] for r in rows}:
            held = [r for r in rows if r[0] == key and r[1] is not None and r[1] <= moment]
            if held:  # a null tie-breaker comes last
                expected.add((key, m, max(held, key=lambda r: (r[1], r[2] is None, r[2] or 0))[3]))
    got = out.select("k", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), "i").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert "WindowGroupLimit" in plan(out)
    same = as_of(df, keys="k", time="at", moments=moments, tie_break="tie", blocks=True)
    assert sorted(map(str, same.select(*out.columns).collect())) == sorted(map(str, out.collect()))


def test_trends_sort_once_a_column(spark):
    """As the rolling statistics one by one, where either value may be missing, with a sort a column and one for the days."""
    dice = random.Random(3)
    rows = [
        (f"A{a}", p, f"2024-{1 + d // 28:02}-{1 + d % 28:02}", *(dice.choice([None, dice.uniform(-50, 50), dice.uniform(-50, 50)]) for _ in range(2)))
        for a in range(3) for p in ("x", "y") for d in range(45)
    ]
    df = spark.createDataFrame(rows, "asset_id string, parameter string, day string, residual double, limit_progress_pct double")
    out = trends(df, blocks=False)
    assert plan(out).count("Sort [") <= 3
    one = df.withColumn("day", F.to_timestamp("day"))
    for column, window, statistics, least, prefix, per in (
        ("residual", 7, "mean,std", 3, "residual_roll", "hour"), ("residual", 21, "slope,zscore", 6, "residual_roll", "day"),
        ("limit_progress_pct", 21, "slope,r_squared", 6, "progress_roll", "day"), ("residual", 30, "std", 10, "residual_roll", "hour"),
    ):
        one = rolling_stats(one, column=column, window=window, statistics=statistics, group_by=SERIES, order_by="day", min_periods=least, prefix=prefix, per=per, blocks=False)
    columns = [c for c in out.columns if not c.startswith("line_")]
    assert columns == one.columns and out.columns[len(columns):] == ["line_n", "line_sxx", "line_syy", "line_sxy"]
    keys = [*SERIES, "day"]
    expected = one.withColumn("day", F.date_format("day", "yyyy-MM-dd")).orderBy(*keys).collect()
    assert out.select(*columns).orderBy(*keys).collect() == expected
    assert trends(df, blocks=True).select(*columns).orderBy(*keys).collect() == expected
