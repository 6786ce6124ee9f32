"""Resampling readings that keep arriving, with a bound on how late they may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomline.functions import values as V

# Periods a streaming window can have; calendar periods vary in length.
WIDTHS = {"hour": "1 hour", "day": "1 day"}
AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def resample_stream(
    readings: DataFrame, *, timestamp: str, measures: dict, period: str = "hour", group_by=None,
    late: str = "10 minutes", output: str = "period",
) -> DataFrame:
    """Closed periods in append mode; state is dropped once the watermark passes them."""
    V.one_of("period", period, WIDTHS)
    groups = V.names(group_by)
    made = [F.count(F.lit(1)).alias("sample_count")]
    for c, hows in measures.items():
        for how in V.names(hows):
            V.one_of("streaming aggregation", how, AGGREGATES)
            made.append(F.round(AGGREGATES[how](V.number(readings, c)), 6).alias(f"{c}_{how}"))
    timed = readings.withColumn("_at", V.moment(readings, timestamp)).withWatermark("_at", late)
    out = timed.groupBy(F.window("_at", WIDTHS[period]).alias("_w"), *[V.col(readings, g) for g in groups]).agg(*made)
    label = "yyyy-MM-dd HH:00:00" if period == "hour" else "yyyy-MM-dd"
    return out.withColumn(output, F.date_format("_w.start", label)).drop("_w")
