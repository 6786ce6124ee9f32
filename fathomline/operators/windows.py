"""Moving statistics, lags, rates and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from fathomline.functions import values as V
from fathomline.operators.ordered import (
    needs_blocks,
    over_present,
    over_rows,
    position,
    running_sum,
)

STATISTICS = (
    "mean", "std", "median", "min", "max", "sum", "count", "slope", "zscore", "range",
    "r_squared",
)


def _statistic(how: str, w: WindowSpec, per: float, value: str = "_v") -> Column:
    y, x = F.col(value), F.col("_x")
    if how == "mean":
        return F.avg(y).over(w)
    if how == "std":
        return F.stddev_samp(y).over(w)
    if how in ("min", "max", "sum"):
        return {"min": F.min, "max": F.max, "sum": F.sum}[how](y).over(w)
    if how == "count":
        return F.count(y).over(w).cast("double")
    if how == "range":
        return F.max(y).over(w) - F.min(y).over(w)
    if how == "median":
        held = F.array_sort(F.collect_list(y).over(w))
        n = F.size(held)
        low = F.get(held, F.floor((n - 1) / 2).cast("int"))
        return (low + F.get(held, F.floor(n / 2).cast("int"))) / 2
    if how == "zscore":
        spread = F.stddev_samp(y).over(w)
        newest = F.last(y, ignorenulls=True).over(w)
        return F.when(spread > 0, (newest - F.avg(y).over(w)) / spread)
    if how == "slope":
        return F.regr_slope(y, x).over(w) * F.lit(per)
    return F.when(F.max(y).over(w) > F.min(y).over(w), F.regr_r2(y, x).over(w))


def rolling_stats(
    df: DataFrame,
    *,
    column: str,
    window: int = 7,
    statistics=("mean",),
    group_by=None,
    order_by,
    min_periods: int = 2,
    per: str = "hour",
    prefix: str | None = None,
    blocks: bool | None = None,
) -> DataFrame:
    """Statistics of the last `window` present values, in time order, per group."""
    V.need(df, column)
    wanted = V.names(statistics) or ["mean"]
    for how in wanted:
        V.one_of("rolling statistic", how, STATISTICS)
    V.one_of("unit", per, V.UNIT_SECONDS)
    if window < 2:
        raise ValueError("window must be at least 2")
    order = V.must_order(order_by)
    p = prefix or f"{column}_roll"
    temporal = not V.is_numeric(V.kind(df, order[0]))
    scale = V.UNIT_SECONDS[per] if temporal else 1.0

    def outputs(w: WindowSpec) -> dict[str, Column]:
        enough = F.count("_v").over(w) >= min_periods
        return {
            f"{p}_{how}{window}": F.when(enough, F.round(_statistic(how, w, scale), 6))
            for how in wanted
        }

    return over_present(
        df.withColumn("_x", V.axis(df, order[0])),
        V.number(df, column),
        outputs,
        window=window,
        group_by=group_by,
        order_by=order,
        blocks=blocks,
    ).drop("_x")


def rolling_together(
    df: DataFrame, wanted: list[dict], *, group_by=None, order_by, blocks: bool | None = None
) -> DataFrame:
    """`rolling_stats` once for each of `wanted`, its options without group and order.

    Where no group is hot, the values of all columns are numbered over one ordering, and frames on one
    column share another, so rows are sorted once a column and not twice an entry.
    """
    groups, order = V.names(group_by), V.must_order(order_by)
    if needs_blocks(df, groups, blocks):
        for one in wanted:
            df = rolling_stats(df, **one, group_by=groups, order_by=order, blocks=True)
        return df
    columns = list(dict.fromkeys(one["column"] for one in wanted))
    place = {c: i for i, c in enumerate(columns)}
    by = [F.col(f"`{g}`") for g in groups]
    upto = Window.partitionBy(*by).orderBy(*V.ordering(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"_x": V.axis(df, order[0]), **{f"_v{i}": V.number(df, c) for c, i in place.items()}})
    out = out.withColumns({f"_k{i}": F.count(f"_v{i}").over(upto) for i in place.values()})
    temporal = not V.is_numeric(V.kind(df, order[0]))
    for c, i in place.items():
        found = {}
        for one in wanted:
            if one["column"] == c:
                w = Window.partitionBy(*by).orderBy(f"_k{i}").rangeBetween(1 - one["window"], 0)
                enough = F.count(f"_v{i}").over(w) >= one.get("min_periods", 2)
                scale = V.UNIT_SECONDS[one.get("per", "hour")] if temporal else 1.0
                for how in V.names(one["statistics"]):
                    V.one_of("rolling statistic", how, STATISTICS)
                    name = f"{one.get('prefix') or c + '_roll'}_{how}{one['window']}"
                    found[name] = F.when(enough, F.round(_statistic(how, w, scale, f"_v{i}"), 6))
        out = out.withColumns(found)
    return out.drop("_x", *[f"_{kind}{i}" for i in place.values() for kind in "vk"])


def moving_average(
    df: DataFrame, *, column: str, window: int = 3, output: str | None = None, order_by
) -> DataFrame:
    """Mean of the last `window` genuine numbers over the whole table."""
    V.need(df, column)
    if window < 1:
        raise ValueError("window must be at least 1")
    target = output or f"{column}_ma{window}"
    return over_present(
        df,
        V.genuine(df, column),
        lambda w: {target: F.round(F.avg("_v").over(w), 6)},
        window=window,
        order_by=order_by,
    )


def lag_column(
    df: DataFrame,
    *,
    column: str,
    periods: int = 1,
    group_by=None,
    order_by,
    output: str | None = None,
    blocks: bool | None = None,
) -> DataFrame:
    V.need(df, column)
    if periods == 0:
        raise ValueError("periods must not be 0")
    side = "lag" if periods > 0 else "lead"
    target = output or f"{column}_{side}{abs(periods)}"
    return over_rows(
        df,
        lambda w: {target: F.lag(V.col(df, column), periods).over(w)},
        group_by=group_by,
        order_by=order_by,
        before=max(periods, 0),
        after=max(-periods, 0),
        blocks=blocks,
    )


def rate_of_change(
    df: DataFrame,
    *,
    column: str,
    periods: int = 1,
    per: str = "hour",
    group_by=None,
    order_by,
    output: str | None = None,
    blocks: bool | None = None,
) -> DataFrame:
    V.need(df, column)
    V.one_of("unit", per, V.UNIT_SECONDS)
    if periods < 1:
        raise ValueError("periods must be at least 1")
    order = V.must_order(order_by)
    y = V.number(df, column)
    # Moments are subtracted as whole microseconds, so short gaps stay exact.
    x, ticks = (
        (V.col(df, order[0]), 1.0)
        if V.is_numeric(V.kind(df, order[0]))
        else (F.unix_micros(V.moment(df, order[0])), 1e6)
    )

    def outputs(w: WindowSpec) -> dict[str, Column]:
        span = (x - F.lag(x, periods).over(w)) / F.lit(ticks * V.UNIT_SECONDS[per])
        moved = y - F.lag(y, periods).over(w)
        return {output or f"{column}_per_{per}": F.when(span > 0, F.round(moved / span, 6))}

    return over_rows(
        df, outputs, group_by=group_by, order_by=order, before=periods, blocks=blocks
    )


def trailing_rows(df: DataFrame, *, k: int, group_by=None, order_by) -> DataFrame:
    """The last k rows of each group."""
    from fathomline.operators.rows import top_per_group

    turned = [o[1:] if o.startswith("-") else f"-{o}" for o in V.must_order(order_by)]
    return top_per_group(df, k=k, group_by=group_by, order_by=turned)


def longest_runs(
    df: DataFrame, *, column: str, group_by=None, order_by, output: str = "longest_flatline",
    blocks: bool | None = None,
) -> DataFrame:
    """Longest run of identical consecutive values per series; 0 without a repeat.

    A missing reading breaks a run, and the value after it is still compared with
    the last one present. Run lengths come from the positions of run starts, so no
    running total over a series is needed.
    """
    groups = V.names(group_by)
    v = V.number(df, column)
    order = V.must_order(order_by)
    base = df.select(
        *[V.col(df, g) for g in groups], *[V.col(df, o.lstrip("-")) for o in order
                                           if o.lstrip("-") not in groups], v.alias("_y")
    )
    blocks = needs_blocks(base, groups, blocks)
    numbered = position(base, "_n", group_by=groups, order_by=order, blocks=blocks)
    present = numbered.where(F.col("_y").isNotNull())

    def starts(w: WindowSpec) -> dict[str, Column]:
        # A repeat continues a run; after a gap it starts one that counts two.
        same = F.col("_y") == F.lag("_y").over(w)
        joined = F.col("_n") == F.lag("_n").over(w) + 1
        return {
            "_same": F.coalesce(same, F.lit(False)),
            "_joined": F.coalesce(joined, F.lit(False)),
        }

    marked = over_rows(
        present, starts, group_by=groups, order_by="_n", before=1, blocks=blocks
    )
    breaks = marked.where(~(F.col("_same") & F.col("_joined")))
    last = numbered.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(
        F.max("_n").alias("_end"), F.max(F.struct("_n", "_y")).alias("_z")
    )
    return _run_lengths(numbered, breaks, last, groups, output, blocks)


def _run_lengths(numbered, breaks, last, groups, output, blocks):
    # Every row that ends a run: a break or a missing reading.
    ends = numbered.where(F.col("_y").isNull()).select(
        *[F.col(f"`{g}`") for g in groups], "_n", F.lit(0).alias("_head")
    )
    heads = breaks.select(
        *[F.col(f"`{g}`") for g in groups], "_n",
        F.when(F.col("_same"), 2).otherwise(1).alias("_head"),
    )
    tails = last.select(
        *[F.col(f"`{g}`") for g in groups], (F.col("_end") + 1).alias("_n"), F.lit(0).alias("_head")
    )
    marks = heads.unionByName(ends).unionByName(tails)
    spans = over_rows(
        marks,
        lambda w: {"_next": F.lead("_n").over(w)},
        group_by=groups, order_by="_n", after=1, blocks=blocks,
    )
    # Length counts the value compared with; a run of one is no repeat.
    length = F.when(F.col("_head") > 0, F.col("_next") - F.col("_n") + F.col("_head") - 1)
    return spans.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(
        F.coalesce(F.max(F.when(length >= 2, length)), F.lit(0)).alias(output)
    )


def level_shift(
    df: DataFrame, *, column: str, group_by=None, order_by, window: int = 12,
    output: str = "largest_step_ratio", least: int | None = None, blocks: bool | None = None,
) -> DataFrame:
    """Largest sustained change of level per series, in units of its own noise."""
    groups = V.names(group_by)
    order = V.must_order(order_by)
    v = V.number(df, column)
    base = df.withColumn("_y", v).where(F.col("_y").isNotNull())
    least = max(least or 0, 3 * window)

    def frames(w: WindowSpec) -> dict[str, Column]:
        back, ahead = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
        full = (F.count("_y").over(back) == window) & (F.count("_y").over(ahead) == window)
        return {
            "_jump": F.when(full, F.abs(F.avg("_y").over(ahead) - F.avg("_y").over(back))),
            "_diff": F.abs(F.col("_y") - F.lag("_y").over(w)),
        }

    framed = over_rows(
        base, frames, group_by=groups, order_by=order, before=window, after=window - 1,
        blocks=blocks,
    )
    noise = F.stddev_samp("_diff") * F.lit((2.0 / window) ** 0.5)
    return framed.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(
        F.when((F.count("_y") >= least) & (noise > 0), F.max("_jump") / noise).alias(output)
    )


def sampling_gaps(
    df: DataFrame, *, time: str, group_by=None, interval_minutes: float, tolerance: float = 2.0,
    tie_break=None, blocks: bool | None = None,
) -> DataFrame:
    """Intervals between consecutive stamps, those too wide, and the widest."""
    groups = V.names(group_by)
    base = df.withColumn("_at", V.moment(df, time)).where(F.col("_at").isNotNull())
    stepped = over_rows(
        base,
        lambda w: {"_gap": (F.unix_micros("_at") - F.unix_micros(F.lag("_at").over(w))) / 6e7},
        group_by=groups, order_by=["_at", *V.names(tie_break)], before=1, blocks=blocks,
    )
    limit = F.lit(interval_minutes * tolerance)
    return stepped.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(
        F.count("_gap").alias("intervals"),
        F.count_if(F.col("_gap") > limit).alias("gaps"),
        F.round(F.max("_gap"), 2).alias("largest_gap_minutes"),
    )


def half_drift(
    df: DataFrame, *, column: str, group_by=None, order_by, output: str = "drift_sigma",
    least: int = 2, blocks: bool | None = None,
) -> DataFrame:
    """Shift between the two halves of a series, in spreads of the first."""
    groups = V.names(group_by)
    base = df.withColumn("_y", V.number(df, column)).where(F.col("_y").isNotNull())
    numbered = position(base, "_n", group_by=groups, order_by=order_by, blocks=blocks)
    by = [F.col(f"`{g}`") for g in groups]
    if groups:
        sizes = base.groupBy(*[F.col(f"`{g}`").alias(f"_k{i}") for i, g in enumerate(groups)]
                             ).agg(F.count("_y").alias("_c"))
        same = V.every(
            [F.col(f"`{g}`").eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]
        )
        numbered = numbered.join(sizes, same)
    else:
        numbered = numbered.withColumn("_c", base.agg(F.count("_y")).scalar())
    early = F.col("_n") <= F.floor(F.col("_c") / 2)
    spread = F.stddev_samp(F.when(early, F.col("_y")))
    shift = F.abs(F.avg(F.when(~early, F.col("_y"))) - F.avg(F.when(early, F.col("_y"))))
    return numbered.groupBy(*by).agg(
        F.when((F.count("_y") >= least) & (spread > 0), shift / spread).alias(output)
    )


def arc_points(
    df: DataFrame, *, track: str, order_by, points: int, values, lat: str = "lat", lon: str = "lon",
    blocks: bool | None = None,
) -> DataFrame:
    """N points at equal spacing along each track, with values interpolated.

    Each segment is handed the targets that fall on it; nothing is paired twice.
    """
    from fathomline.functions.geo import great_circle_km

    order, carried = V.must_order(order_by), [lat, lon, *V.names(values)]
    ahead = df.select(V.col(df, track), *[V.col(df, o) for o in order],
                      *[V.number(df, c).alias(c) for c in carried])
    blocks = needs_blocks(ahead, [track], blocks)
    ahead = over_rows(
        ahead,
        lambda w: {f"_n_{c}": F.lead(c).over(w) for c in carried},
        group_by=[track], order_by=order, after=1, blocks=blocks,
    )
    ahead = ahead.withColumn(
        "_len",
        F.coalesce(great_circle_km(F.col(lat), F.col(lon), F.col(f"_n_{lat}"), F.col(f"_n_{lon}")),
                   F.lit(0.0)),
    )
    ahead = running_sum(
        ahead, F.col("_len"), "_done", group_by=[track], order_by=order, blocks=blocks
    )
    ahead = ahead.withColumn("_from", F.col("_done") - F.col("_len"))
    whole = ahead.groupBy(V.col(df, track).alias("_t")).agg(F.sum("_len").alias("_whole"))
    spaced = ahead.join(whole, V.col(df, track) == F.col("_t")).drop("_t")
    step = F.col("_whole") / F.lit(points - 1)
    final = F.col(f"_n_{lat}").isNull()
    first = F.ceil(F.round(F.col("_from") / step, 9))
    stop = F.ceil(F.round(F.col("_done") / step, 9)) - 1
    mine = (
        F.when(F.col("_whole") == 0, F.when(final, F.sequence(F.lit(0).cast("bigint"),
                                                              F.lit(points - 1).cast("bigint"))))
        .when(final, F.array(F.lit(points - 1).cast("bigint")))
        .when((F.col("_len") > 0) & (first <= stop),
              F.sequence(first, F.least(stop, F.lit(points - 2).cast("bigint"))))
    )
    placed = spaced.withColumn("_k", F.explode(mine))
    share = F.when((F.col("_len") > 0) & (F.col("_whole") > 0),
                   (F.col("_k") * step - F.col("_from")) / F.col("_len")).otherwise(F.lit(0.0))
    return placed.select(
        V.col(df, track),
        F.col("_k").alias("step"),
        *[
            (F.col(c) + F.coalesce((F.col(f"_n_{c}") - F.col(c)) * share, F.lit(0.0))).alias(c)
            for c in carried
        ],
    )
