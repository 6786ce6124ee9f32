"""Aggregations. Everything here combines on the map side before it shuffles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fathomline.functions import values as V
from fathomline.operators.quantiles import quantiles
from fathomline.session import has_hot_group

BASIC = ("sum", "mean", "min", "max", "count")
SUMMARIES = (*BASIC, "median")
# Commonest values told of a column without numbers.
TOP_VALUES = 12


def _basic(c: Column, how: str) -> Column:
    return {
        "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count,
    }[how](c)


def _by_text(df: DataFrame, groups: list[str]) -> list[Column]:
    return [V.text(df, g).asc() for g in groups]


def group_aggregate(
    df: DataFrame, *, group_by, column: str, agg: str = "sum", sort: bool = True
) -> DataFrame:
    """One aggregate of genuine numbers; groups without any vanish."""
    groups = V.names(group_by)
    V.one_of("aggregation", agg, BASIC)
    V.need(df, *groups, column)
    rows = df.select(*[V.col(df, g) for g in groups], V.genuine(df, column).alias("_v"))
    value = _basic(F.col("_v"), agg).cast("double")
    out = rows.where(F.col("_v").isNotNull()).groupBy(*[V.col(df, g) for g in groups]).agg(
        F.round(value, 6).alias(f"{column}_{agg}"), F.count("_v").alias("count")
    )
    return out.orderBy(*_by_text(out, groups)) if sort else out


def summarise(
    df: DataFrame,
    *,
    group_by,
    measures: dict[str, str],
    sort: bool = True,
    blocks: bool | None = None,
) -> DataFrame:
    """Several keys and measures; text numbers are read, an empty measure is null."""
    groups = V.names(group_by)
    if not groups or not measures:
        raise ValueError("summarise needs group_by and measures")
    V.need(df, *groups, *measures)
    for how in measures.values():
        V.one_of("aggregation", how, SUMMARIES)
    by = [V.col(df, g) for g in groups]
    medians = [c for c, how in measures.items() if how == "median"]
    hot = bool(medians) and (has_hot_group(df, groups) if blocks is None else blocks)
    made = [F.count(F.lit(1)).alias("row_count")]
    for c, how in measures.items():
        if how == "median":
            answer = F.lit(None) if hot else F.median(V.number(df, c))
        elif how == "count":
            answer = F.count(F.lit(1)).cast("double")
        else:
            answer = _basic(V.number(df, c), how)
        made.append(F.round(answer.cast("double"), 6).alias(f"{c}_{how}"))
    out = df.groupBy(*by).agg(*made)
    if hot:
        for c in medians:
            exact = quantiles(df, V.number(df, c), [0.5], group_by=groups, output="_q", blocks=True)
            exact = exact.withColumnsRenamed({g: f"_q_{g}" for g in groups})
            same = V.every([F.col(f"`{g}`").eqNullSafe(F.col(f"`_q_{g}`")) for g in groups])
            out = (
                out.join(exact, same, "left")
                .withColumn(f"{c}_median", F.round(F.col("_q")[0], 6))
                .drop("_q", *[f"_q_{g}" for g in groups])
            )
    return out.orderBy(*_by_text(out, groups)) if sort else out


def explore_aggregate(df: DataFrame, *, by: str, columns, agg: str) -> DataFrame:
    """One key, many columns, one aggregate; `count` counts rows and the null key stays."""
    V.one_of("aggregation", agg, BASIC)
    wanted = V.names(columns)
    V.need(df, by, *wanted)
    if agg == "count":
        return df.groupBy(V.col(df, by)).agg(F.count(F.lit(1)).alias("count"))
    return df.groupBy(V.col(df, by)).agg(
        *[_basic(V.float_view(df, c), agg).alias(f"{c}_{agg}") for c in wanted]
    )


def profile(
    df: DataFrame, *, columns=None, exact: bool = True, blocks: bool | None = None, top: int = TOP_VALUES
) -> DataFrame:
    """One row per column: counts, spread, median, and the commonest values of a column without numbers.

    Columns are turned into one table of (column, value, count), combined on the map side; every figure is
    read from it, so the table is scanned once. Where it is large, medians come from rounds of selection over
    all columns together. With `exact=False` distinct counts and medians are sketched in one plain pass, and
    there are no common values. Nested values count as they are printed; an empty table has a row per column.
    """
    wanted = V.names(columns) or df.columns
    V.need(df, *wanted)
    listed = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(c).alias("column"), F.lit(V.kind(df, c).simpleString()).alias("type"))
        for i, c in enumerate(wanted)
    ])))
    told = _counted_columns(df, wanted, blocks, top) if exact else _sketched_columns(df, wanted)
    rows, nulls = F.coalesce("_rows", F.lit(0)), F.coalesce("_nulls", F.lit(0))
    return listed.join(told, "_i", "left").select(
        "column", "type", rows.alias("count"), nulls.alias("null_count"),
        F.round(F.coalesce(F.try_divide(nulls, rows), F.lit(0.0)), 4).alias("null_ratio"),
        F.coalesce("_distinct", F.lit(0)).alias("distinct_count"),
        F.col("_min").alias("min"), F.col("_max").alias("max"), F.round("_mean", 6).alias("mean"),
        F.col("_median").alias("median"),
        F.when(F.col("_min").isNotNull(), F.round(F.coalesce("_sd", F.lit(0.0)), 6)).alias("stddev"),
        F.when(F.col("_min").isNull(), F.col("_top")).alias("top_values"),
    )


def _distinct_text(df: DataFrame, column: str) -> Column:
    """A value as text that differs where values differ."""
    c, kind = V.col(df, column), V.kind(df, column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0).cast(kind)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _measured(df: DataFrame, column: str) -> Column:
    """The number a value is; nested and binary values are none."""
    if isinstance(V.kind(df, column), (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return F.lit(None).cast("double")
    return V.float_view(df, column)


def _counted_columns(df: DataFrame, wanted: list[str], blocks: bool | None, top: int) -> DataFrame:
    hot = has_hot_group(df, []) if blocks is None else blocks
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), _distinct_text(df, c).alias("_k"), _measured(df, c).alias("_x"))
        for i, c in enumerate(wanted)
    ])))
    counts = cells.groupBy("_i", "_k", "_x").agg(F.count(F.lit(1)).alias("_c"))
    held = F.sum(F.when(F.col("_x").isNotNull(), F.col("_c")))
    made = [
        F.sum("_c").alias("_rows"), F.sum(F.when(F.col("_k").isNull(), F.col("_c"))).alias("_nulls"),
        F.count("_k").alias("_distinct"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        held.alias("_held"), (F.sum(F.col("_x") * F.col("_c")) / held).alias("_mean"),
    ]
    if not hot:
        made.append(F.percentile("_x", F.lit(0.5), F.col("_c")).alias("_median"))
    figures = counts.groupBy("_i").agg(*made)
    # Squares around the mean need it first; the exchange of the counts is used again, and a row per column sent.
    off = F.col("_x") - F.col("_mean")
    squares = counts.join(F.broadcast(figures.select("_i", "_mean")), "_i").groupBy("_i").agg(
        F.sum(off * off * F.col("_c")).alias("_squares")
    )
    # Filters on the keys would move below the counting and spoil that, so other rows are put last instead.
    other = F.col("_k").isNull() | F.col("_x").isNotNull()
    best = Window.partitionBy("_i").orderBy(other, F.col("_c").desc(), "_k")
    common = counts.withColumn("_place", F.row_number().over(best)).where(
        (F.col("_place") <= top) & ~other
    ).groupBy("_i").agg(F.array_sort(F.collect_list(
        F.struct("_place", F.col("_k").alias("value"), F.col("_c").alias("count"))
    )).alias("_listed"))
    out = figures.join(squares, "_i", "left").join(common, "_i", "left")
    if hot:
        half = quantiles(cells, F.col("_x"), [0.5], group_by="_i", blocks=True)
        out = out.join(half.select("_i", F.col("quantiles")[0].alias("_median")), "_i", "left")
    return out.withColumns({
        "_sd": F.sqrt(F.try_divide(F.col("_squares"), F.col("_held") - 1)),
        "_top": F.transform("_listed", lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count"))),
    })


def _sketched_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    made = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(wanted):
        v, raw = _measured(df, c), V.col(df, c)
        made += [
            F.count_if(raw.isNull()).alias(f"_nulls{i}"),
            F.approx_count_distinct(_distinct_text(df, c)).alias(f"_distinct{i}"),
            F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"), F.avg(v).alias(f"_mean{i}"),
            F.stddev_samp(v).alias(f"_sd{i}"), F.percentile_approx(v, 0.5).alias(f"_median{i}"),
        ]
    parts = ("_nulls", "_distinct", "_min", "_max", "_mean", "_sd", "_median")
    none = F.lit(None).cast("array<struct<value:string,count:bigint>>")
    return df.agg(*made).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), "_rows", *[F.col(f"{p}{i}").alias(p) for p in parts], none.alias("_top"))
        for i in range(len(wanted))
    ])))


def column_stats(df: DataFrame, *, column: str) -> DataFrame:
    v = V.float_view(df, column)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))


def distinct_values(df: DataFrame, *, column: str) -> DataFrame:
    V.need(df, column)
    return df.select(V.col(df, column)).distinct()


def value_counts(df: DataFrame, *, column: str, top: int | None = None) -> DataFrame:
    """The commonest values; equal counts by value."""
    V.need(df, column)
    out = (
        df.where(V.col(df, column).isNotNull())
        .groupBy(V.col(df, column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("value").cast("string"))
    )
    return out if top is None else out.limit(top)


def numeric_values(df: DataFrame, *, column: str) -> DataFrame:
    return df.select(V.float_view(df, column).alias(column)).where(F.col(f"`{column}`").isNotNull())


def percent_of_total(df: DataFrame, *, column: str, output: str | None = None) -> DataFrame:
    V.need(df, column)
    v = V.number(df, column)
    whole = df.agg(F.sum(v)).scalar()
    share = F.when(
        F.coalesce(whole, F.lit(0.0)) == 0,
        F.raise_error(F.lit(f"{column} sums to zero, so it has no shares")).cast("double"),
    ).otherwise(F.round(100 * v / whole, 4))
    return df.withColumn(output or f"{column}_pct", F.when(v.isNotNull(), share))


def zscore_outliers(df: DataFrame, *, column: str, threshold: float = 3.0) -> DataFrame:
    V.need(df, column)
    v = V.genuine(df, column)
    v = F.when(~F.isnan(v), v)
    parts = df.agg(
        F.struct(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    ).scalar()
    spread = F.when(parts["s"] == 0, F.lit(1e-12)).otherwise(parts["s"])
    score = F.when(
        parts["n"] < 2,
        F.raise_error(F.lit(f"{column} has too few numbers for a spread")).cast("double"),
    ).otherwise((v - parts["m"]) / spread)
    return df.withColumn("zscore", F.round(F.when(v.isNotNull(), score), 6)).withColumn(
        "is_outlier", F.abs("zscore") > threshold
    )


def linear_trend(
    df: DataFrame,
    *,
    column: str,
    order_by,
    group_by=None,
    per: str = "day",
    min_periods: int = 3,
    prefix: str | None = None,
) -> DataFrame:
    """A least-squares line per group, from its first observation."""
    V.one_of("unit", per, V.UNIT_SECONDS)
    groups, order = V.names(group_by), V.must_order(order_by)
    V.need(df, column, *groups, *order)
    p = prefix or column
    unit = V.UNIT_SECONDS[per]
    rows = df.select(
        *[V.col(df, g) for g in groups],
        V.number(df, column).alias("_y"),
        (V.axis(df, order[0]) / F.lit(unit)).alias("_x"),
        F.struct(*[V.col(df, o).alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"),
        V.col(df, order[0]).cast("string").alias("_seen"),
    ).where(F.col("_y").isNotNull() & F.col("_x").isNotNull())
    y, x, o = F.col("_y"), F.col("_x"), F.col("_o")
    fitted = rows.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(
        F.count(y).alias("_n"),
        F.regr_slope(y, x).alias("_b"),
        F.avg(y).alias("_my"),
        F.avg(x).alias("_mx"),
        F.min(x).alias("_x0"),
        F.when(F.var_pop(y) > 0, F.regr_r2(y, x)).alias("_r2"),
        F.min_by(F.struct(y.alias("y"), F.col("_seen").alias("s")), o).alias("_first"),
        F.max_by(F.struct(y.alias("y"), F.col("_seen").alias("s")), o).alias("_last"),
    )
    # Every group keeps its row, also one without a usable reading.
    keys = df.select(*[V.col(df, g) for g in groups]).distinct() if groups else None
    if groups:
        fitted = fitted.withColumnsRenamed({g: f"_k{i}" for i, g in enumerate(groups)})
        same = V.every(
            [F.col(f"`{g}`").eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]
        )
        fitted = keys.join(fitted, same, "left")
    slope = F.when(F.col("_n") >= min_periods, F.col("_b"))
    change = F.col("_last.y") - F.col("_first.y")
    pct = F.when(F.col("_first.y") != 0, F.round(100 * change / F.abs("_first.y"), 4))
    r2 = F.when(slope.isNotNull(), F.col("_r2"))
    direction = (
        F.when(slope.isNull(), "unknown")
        .when(r2 < 0.2, "unstable")
        .when(F.abs(F.coalesce(pct, F.lit(0.0))) < 2, "stable")
        .when(slope > 0, "increasing")
        .otherwise("decreasing")
    )
    return fitted.select(
        *[F.col(f"`{g}`") for g in groups],
        F.coalesce(F.col("_n"), F.lit(0)).alias(f"{p}_points"),
        F.round(slope, 8).alias(f"{p}_slope_per_{per}"),
        F.round(F.col("_my") - slope * (F.col("_mx") - F.col("_x0")), 6).alias(f"{p}_intercept"),
        F.round(r2, 6).alias(f"{p}_r_squared"),
        F.col("_first.y").alias(f"{p}_first_value"),
        F.col("_last.y").alias(f"{p}_last_value"),
        F.round(change, 6).alias(f"{p}_change"),
        pct.alias(f"{p}_change_pct"),
        direction.alias(f"{p}_direction"),
        F.col("_first.s").alias(f"{p}_first_seen"),
        F.col("_last.s").alias(f"{p}_last_seen"),
    )


def correlation(df: DataFrame, *, columns, group_by=None, min_periods: int = 5) -> DataFrame:
    """Pearson of every pair per group; null when too few points or a flat side."""
    wanted, groups = V.names(columns), V.names(group_by)
    if len(wanted) < 2:
        raise ValueError("correlation needs at least two columns")
    V.need(df, *wanted, *groups)
    entries = []
    for a, b in combinations(wanted, 2):
        x, y = V.number(df, a), V.number(df, b)
        spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
        n = F.regr_count(y, x)
        r = F.when((n >= min_periods) & (spread > 0), F.regr_sxy(y, x) / spread)
        entries.append(
            F.struct(
                F.lit(a).alias("measurement_a"),
                F.lit(b).alias("measurement_b"),
                F.round(r, 6).alias("correlation"),
                n.alias("points"),
            )
        )
    by = [V.col(df, g) for g in groups]
    pairs = df.groupBy(*by).agg(F.array(*entries).alias("_pairs"))
    return pairs.select(*[F.col(f"`{g}`") for g in groups], F.inline("_pairs"))


def confusion_rates(
    df: DataFrame, *, actual: str, predicted: str, group_by=None, total: str | None = None
) -> DataFrame:
    """TP FP FN TN and the rates they give, per group and, if named, in total."""
    groups = V.names(group_by)
    said, real = V.col(df, predicted), V.col(df, actual)
    counted = df.groupBy(*[V.col(df, g).cast("string").alias(g) for g in groups]).agg(
        F.count_if(said & real).alias("tp"),
        F.count_if(said & ~real).alias("fp"),
        F.count_if(~said & real).alias("fn"),
        F.count_if(~said & ~real).alias("tn"),
    )
    if total is not None and groups:
        whole = counted.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).select(
            *[F.lit(total if i == 0 else None).alias(g) for i, g in enumerate(groups)],
            "tp", "fp", "fn", "tn",
        )
        counted = counted.unionByName(whole)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counted.withColumns(
        {
            "precision": F.round(precision, 4),
            "recall": F.round(recall, 4),
            "f1": F.round(ratio(2 * precision * recall, precision + recall), 4),
            "specificity": F.round(ratio(tn, tn + fp), 4),
            "alert_rate": F.round(ratio(tp + fp, tp + fp + fn + tn), 4),
        }
    )


def class_accuracy(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    """Per class, overall and macro accuracy; rows without both labels are skipped."""
    real, said = V.col(df, actual), V.col(df, predicted)
    usable = df.where(~V.blank(df, actual) & ~V.blank(df, predicted))
    per = usable.groupBy(real.cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(real == said).alias("correct")
    )
    per = per.withColumn("accuracy", F.col("correct") / F.col("total"))
    overall = per.agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"),
                      F.avg("accuracy").alias("macro"))
    rows = overall.select(
        F.inline(
            F.array(
                F.struct(F.lit("(overall)").alias("class"), "total", "correct",
                         F.try_divide("correct", "total").alias("accuracy")),
                F.struct(F.lit("(macro)").alias("class"), "total", "correct",
                         F.col("macro").alias("accuracy")),
            )
        )
    )
    return per.unionByName(rows).withColumn("accuracy", F.round("accuracy", 6))


def confusion_pairs(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    usable = df.where(~V.blank(df, actual) & ~V.blank(df, predicted))
    return usable.groupBy(
        V.col(df, actual).alias("actual"), V.col(df, predicted).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("count"))


def weighted_aggregate(
    df: DataFrame, *, value: str, weight: str, group_by=None, thresholds=()
) -> DataFrame:
    """Weighted mean, exceedance share per threshold, and effective sample size."""
    groups = V.names(group_by)
    v, w = V.number(df, value), V.number(df, weight)
    w = F.when(v.isNotNull(), w)
    whole = F.sum(w)
    return df.groupBy(*[V.col(df, g) for g in groups]).agg(
        F.count(w).alias("samples"),
        F.coalesce(F.try_divide(F.sum(v * w), whole), F.lit(0.0)).alias("expected"),
        *[
            F.coalesce(
                F.try_divide(F.sum(F.when(v >= F.lit(float(t)), w).otherwise(F.lit(0.0))), whole),
                F.lit(0.0),
            ).alias(f"prob_{V.short(float(t)).replace('.', '_')}")
            for t in thresholds
        ],
        F.round(F.coalesce(F.try_divide(whole * whole, F.sum(w * w)), F.lit(0.0)), 1).alias(
            "effective"
        ),
    )


def circular_mean(angle: Column) -> Column:
    """The mean direction of angles in radians, as an aggregate expression."""
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))
