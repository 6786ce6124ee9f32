"""The queries behind charts: series, histograms, boxes and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.operators.aggregate import BASIC, explore_aggregate
from fathomline.operators.quantiles import quantiles
from fathomline.operators.rows import category_order

BINS = (2, 60)


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def plain_series(df: DataFrame, *, x: str, y, order_by, limit: int | None = None) -> DataFrame:
    wanted = V.names(y)
    V.need(df, x, *wanted)
    rows = _first(df.orderBy(*V.ordering(V.must_order(order_by))), limit)
    return rows.select(V.col(df, x), *[V.float_view(df, c).alias(c) for c in wanted])


def aggregated_series(
    df: DataFrame, *, x: str, y, aggregation: str, stated=None, limit: int | None = None
) -> DataFrame:
    out = explore_aggregate(df, by=x, columns=y, agg=aggregation)
    out = out.withColumns({c: F.round(c, 6) for c in out.columns if c != x and c != "count"})
    return _first(category_order(out, column=x, stated=stated), limit)


def _label(low: Column, high: Column) -> Column:
    span = high - low
    return (
        F.when(span >= 10, F.format_string("%.0f-%.0f", low, high))
        .when(span >= 1, F.format_string("%.1f-%.1f", low, high))
        .otherwise(F.format_string("%.2f-%.2f", low, high))
    )


def histogram(df: DataFrame, *, column: str, bins: int = 12) -> DataFrame:
    """Equal-width buckets; the top edge is in the last, empty ones count 0."""
    if not BINS[0] <= bins <= BINS[1]:
        raise ValueError(f"bins must lie between {BINS[0]} and {BINS[1]}")
    v = V.float_view(df, column)
    ends = df.agg(F.min(v).alias("low"), F.max(v).alias("high"))
    # Both ends in one scalar subquery; each row finds its bucket by arithmetic.
    both = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high"))).scalar()
    width = (both["high"] - both["low"]) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((v - both["low"]) / width))
    )
    counts = df.where(v.isNotNull()).groupBy(at.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count")
    )
    slots = F.when(F.col("low") < F.col("high"), F.sequence(F.lit(0), F.lit(bins - 1))).when(
        F.col("low").isNotNull(), F.array(F.lit(0))
    )
    grid = ends.withColumn("bucket", F.explode(slots)).withColumn(
        "_w", (F.col("high") - F.col("low")) / bins
    )
    lower = F.col("low") + F.col("_w") * F.col("bucket")
    upper = F.col("low") + F.col("_w") * (F.col("bucket") + 1)
    return grid.join(counts, "bucket", "left").select(
        F.col("bucket").cast("long").alias("bucket"),
        lower.alias("lower"),
        upper.alias("upper"),
        _label(lower, upper).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def distribution(df: DataFrame, *, column: str, blocks: bool | None = None) -> DataFrame:
    v = V.float_view(df, column)
    q = quantiles(df, v, [0.5, 0.9], blocks=blocks).select("quantiles").scalar()
    out = df.agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.count(v).alias("counted"),
    )
    return out.withColumn("median", q[0]).withColumn("p90", q[1])


def box(
    df: DataFrame, *, x: str, y: str, stated=None, limit: int | None = None, blocks: bool | None = None
) -> DataFrame:
    """Quartiles, Tukey whiskers, size and outlier count per category."""
    fenced = _fenced(df, x, y, blocks)
    v = F.col("_y")
    inside = (v >= F.col("_low")) & (v <= F.col("_high"))
    out = fenced.groupBy("_x").agg(
        F.coalesce(F.min(F.when(inside, v)), F.min(v)).alias("min"),
        F.first("_q").alias("_q"),
        F.coalesce(F.max(F.when(inside, v)), F.max(v)).alias("max"),
        F.count_if(~inside).alias("outliers"),
        F.count(v).alias("size"),
    )
    out = out.select(
        F.col("_x").alias(x), "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q3"), "max", "outliers", "size",
    )
    return _first(category_order(out, column=x, stated=stated), limit)


def box_outliers(
    df: DataFrame, *, x: str, y: str, limit: int | None = None, blocks: bool | None = None
) -> DataFrame:
    v = F.col("_y")
    far = _fenced(df, x, y, blocks).where((v < F.col("_low")) | (v > F.col("_high")))
    out = far.select(F.col("_x").alias("category"), v.alias("value"))
    return _first(out.orderBy(V.text(out, "category"), "value"), limit)


def _fenced(df: DataFrame, x: str, y: str, blocks) -> DataFrame:
    V.need(df, x, y)
    rows = df.select(V.col(df, x).alias("_x"), V.float_view(df, y).alias("_y")).where(
        F.col("_y").isNotNull()
    )
    q = quantiles(rows, F.col("_y"), [0.25, 0.5, 0.75], group_by=["_x"], output="_q", blocks=blocks)
    q = q.withColumnRenamed("_x", "_k")
    reach = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    return rows.join(q, F.col("_x").eqNullSafe(F.col("_k"))).withColumns(
        {"_low": F.col("_q")[0] - reach, "_high": F.col("_q")[2] + reach}
    )


def grid(
    df: DataFrame,
    *,
    x: str,
    series: str,
    y: str,
    aggregation: str = "none",
    order_by=None,
    limit: int | None = None,
    stated=None,
) -> DataFrame:
    """x by series, one cell each; an empty cell is null, and 0 when counting."""
    V.one_of("aggregation", aggregation, ("none", *BASIC))
    V.need(df, x, series, y)
    v = V.float_view(df, y)
    if aggregation == "none":
        at = F.struct(*[V.col(df, o) for o in V.must_order(order_by)])
        value = F.min_by(v, F.when(v.isNotNull(), at))
    else:
        value = {
            "sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v),
            "count": F.count(F.lit(1)).cast("double"),
        }[aggregation]
    cells = df.groupBy(V.col(df, x).alias("_x"), V.col(df, series).alias("_s")).agg(
        F.round(value, 6).alias("value")
    )
    # Axes come from the cells, so the table is read once for each side only.
    xs = cells.select(F.col("_x").alias(x)).distinct()
    if limit is not None:
        xs = category_order(xs, column=x, stated=stated).limit(limit)
    # The answer itself is every x with every series; both axes are distinct values, joined as tables.
    bands = cells.select(F.col("_s").alias("_ks")).distinct()
    full = xs.select(F.col(f"`{x}`").alias("_kx")).join(bands)
    same = F.col("_x").eqNullSafe(F.col("_kx")) & F.col("_s").eqNullSafe(F.col("_ks"))
    out = full.join(cells, same, "left")
    shown = F.coalesce("value", F.lit(0.0)) if aggregation == "count" else F.col("value")
    return out.select(F.col("_kx").alias(x), F.col("_ks").alias(series), shown.alias("value"))
