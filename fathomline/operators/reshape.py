"""Long to wide, wide to long, and readings onto fixed periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fathomline.functions import values as V
from fathomline.operators.quantiles import quantiles

CELLS = ("mean", "sum", "min", "max", "median", "count", "first", "last")
PERIODS = {
    "hour": "yyyy-MM-dd HH:00:00",
    "day": "yyyy-MM-dd",
    "week": "yyyy-MM-dd",
    "month": "yyyy-MM-dd",
    "quarter": "yyyy-MM-dd",
    "year": "yyyy-MM-dd",
}
MEASURES = ("mean", "sum", "min", "max", "median", "count", "first", "last", "std")


def pivot_wider(
    df: DataFrame,
    *,
    keys,
    name_from: str,
    value_from: str,
    aggregation: str = "mean",
    prefix: str = "",
    order_by,
    labels: list[str] | None = None,
) -> DataFrame:
    """One column per measurement, in order of first appearance.

    Only the measurement names come to the driver; pass `labels` to skip that job.
    """
    groups, order = V.names(keys), V.must_order(order_by)
    V.one_of("aggregation", aggregation, CELLS)
    V.need(df, *groups, name_from, value_from)
    named = df.withColumn("_name", V.col(df, name_from).cast("string")).where(
        F.col("_name").isNotNull() & (F.col("_name") != "")
    )
    at = F.struct(*[V.col(df, o) for o in order])
    if labels is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = named.groupBy("_name").agg(F.min(at).alias("_at")).orderBy("_at").limit(most + 1)
        labels = [r["_name"] for r in found.collect()]
        if len(labels) > most:
            raise ValueError(f"{name_from} has over {most} names: raise spark.sql.pivotMaxValues")
    if not labels:
        raise ValueError(f"{name_from} holds no names to make columns of")
    by = [V.col(df, g) for g in groups]
    v, raw = V.number(df, value_from), V.col(df, value_from)
    if aggregation == "median":
        cells = quantiles(
            named.select(*by, "_name", v.alias("_v")), F.col("_v"), [0.5],
            group_by=[*groups, "_name"],
        )
        wide = cells.groupBy(*by).pivot("_name", labels).agg(F.round(F.max(F.col("quantiles")[0]), 6))
    else:
        numeric = {
            "mean": F.round(F.avg(v), 6),
            "sum": F.round(F.sum(v), 6),
            "min": F.min(v),
            "max": F.max(v),
            "count": F.count(F.lit(1)).cast("double"),
            "first": F.min_by(raw, at),
            "last": F.max_by(raw, at),
        }[aggregation]
        if isinstance(V.kind(df, value_from), T.StringType) and aggregation in (
            "mean", "sum", "min", "max",
        ):
            # A cell of text without a number shows its last value.
            numeric = F.coalesce(numeric.cast("string"), F.max_by(raw, at))
        if aggregation == "count":
            numeric = F.when(F.count(F.lit(1)) > 0, numeric)
        wide = named.groupBy(*by).pivot("_name", labels).agg(numeric)
    return wide.select(*by, *[F.col(f"`{x}`").alias(f"{prefix}{x}") for x in labels])


def unpivot_longer(
    df: DataFrame,
    *,
    keys,
    columns=None,
    name_to: str = "measurement",
    value_to: str = "value",
    drop_missing: bool = True,
) -> DataFrame:
    groups = V.names(keys)
    wanted = V.names(columns) or [c for c in df.columns if c not in groups]
    V.need(df, *groups, *wanted)
    if not wanted:
        raise ValueError("unpivot_longer has no column to unpivot")
    # Columns of one type keep it; numbers meet as doubles, anything else as text.
    dtypes = {V.kind(df, c).simpleString() for c in wanted}
    numeric = all(V.is_numeric(V.kind(df, c)) for c in wanted)
    shared = dtypes.pop() if len(dtypes) == 1 else ("double" if numeric else "string")
    slim = df.select(
        *[V.col(df, g) for g in groups], *[V.col(df, c).cast(shared).alias(c) for c in wanted]
    )
    long = slim.unpivot(groups, wanted, name_to, value_to)
    return long.where(F.col(f"`{value_to}`").isNotNull()) if drop_missing else long


def period_label(at: Column, period: str) -> Column:
    V.one_of("period", period, PERIODS)
    return F.date_format(F.date_trunc(period, at), PERIODS[period])


def resample_time(
    df: DataFrame,
    *,
    timestamp: str,
    measures: dict,
    period: str = "day",
    group_by=None,
    output: str = "period",
    order_by=None,
    sort: bool = True,
) -> DataFrame:
    """Readings aggregated onto hours, days, weeks, months, quarters or years."""
    groups = V.names(group_by)
    V.need(df, timestamp, *groups, *measures)
    V.one_of("period", period, PERIODS)
    if not measures:
        raise ValueError("resample_time needs measures")
    plan = [(c, how) for c, hows in measures.items() for how in V.names(hows)]
    for _, how in plan:
        V.one_of("aggregation", how, MEASURES)
    rows = df.withColumn("_at", V.moment(df, timestamp)).where(F.col("_at").isNotNull())
    rows = rows.withColumn("_period", period_label(F.col("_at"), period))
    at = F.struct("_at", *[V.col(df, o) for o in V.names(order_by)])
    made = [F.count(F.lit(1)).alias("sample_count")]
    for c, how in plan:
        v = V.number(df, c)
        if how == "median":
            continue
        answer = {
            "mean": F.avg(v),
            "sum": F.sum(v),
            "min": F.min(v),
            "max": F.max(v),
            "count": F.count(v).cast("double"),
            "std": F.stddev_samp(v),
            "first": F.min_by(v, F.when(v.isNotNull(), at)),
            "last": F.max_by(v, F.when(v.isNotNull(), at)),
        }[how]
        made.append(F.round(answer, 6).alias(f"{c}_{how}"))
    keys = [*groups, "_period"]
    out = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*made)
    for c in [c for c, how in plan if how == "median"]:
        exact = quantiles(rows, V.number(df, c), [0.5], group_by=keys, output="_q")
        exact = exact.withColumnsRenamed({k: f"_q_{k}" for k in keys})
        same = V.every([F.col(f"`{k}`").eqNullSafe(F.col(f"`_q_{k}`")) for k in keys])
        out = out.join(exact, same, "left").withColumn(f"{c}_median", F.round(F.col("_q")[0], 6))
    out = out.select(
        *[F.col(f"`{g}`") for g in groups],
        F.col("_period").alias(output),
        "sample_count",
        *[F.col(f"`{c}_{how}`") for c, how in plan],
    )
    return out.orderBy(*[V.text(out, k) for k in [*groups, output]]) if sort else out
