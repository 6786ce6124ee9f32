"""Rain: event totals of analogs, and fields conditioned on where a storm is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.functions import values as V
from fathomline.operators.aggregate import weighted_aggregate
from fathomline.operators.joins import within_distance

# Words for no data, mm/h thresholds, kernel widths.
NO_RAIN = ("", "---", "nan", "none", "na", "n/a")
THRESHOLDS = (1.0, 5.0, 10.0, 20.0, 30.0)
BANDWIDTH_KM, CUTOFF_FACTOR, WIND_SCALE_KT = 150.0, 3.0, 25.0
# Cells of a moment's field that travel in one row.
_FIELD = 4_096


def event_rain(c: Column) -> Column:
    """The number in a rain text; null for the words that mean none."""
    text = F.trim(c.cast("string"))
    return F.when(
        ~F.lower(text).isin(*NO_RAIN), F.regexp_substr(text, F.lit(r"-?\d+(\.\d+)?")).try_cast("double")
    )


def analog_rain(neighbours: DataFrame, rain: DataFrame, *, key: str, regions) -> DataFrame:
    """Event-rain statistics per query and region over its analogs, which are k at most."""
    wanted = V.names(regions)
    long = rain.select(
        V.col(rain, key).alias("item_id"),
        F.explode(F.array(*[
            F.struct(F.lit(r).alias("region"), event_rain(V.col(rain, r)).alias("rain")) for r in wanted
        ])).alias("_e"),
    ).select("item_id", "_e.region", "_e.rain").where(F.col("rain").isNotNull())
    return neighbours.join(long, "item_id").groupBy("query_id", "region").agg(
        F.round(F.avg("rain"), 1).alias("mean"),
        F.round(F.median("rain"), 1).alias("median"),
        F.round(F.min("rain"), 1).alias("min"),
        F.round(F.max("rain"), 1).alias("max"),
        F.count("rain").alias("count"),
    )


def conditioned_rain(
    steps: DataFrame, moments: DataFrame, fields: DataFrame, *, step, thresholds=THRESHOLDS,
    bandwidth_km: float = BANDWIDTH_KM, use_wind: bool = True,
) -> DataFrame:
    """Kernel-weighted rain per query point and grid cell.

    steps: (step..., lat, lon, wind_kt); moments: (moment_id, storm_lat, storm_lon,
    storm_wind); fields: (moment_id, cell_id, rain_mm_h). A moment brings its field along, so
    that points and cells are summed where they meet, and what is shuffled is a row per moment
    or per point and cell.
    """
    keys = V.names(step)
    cells = fields.select("moment_id", F.struct("cell_id", "rain_mm_h").alias("_cell")).withColumn(
        "_chunk", F.floor((F.row_number().over(Window.partitionBy("moment_id").orderBy("_cell.cell_id")) - 1) / _FIELD)
    )
    held = cells.groupBy("moment_id", "_chunk").agg(F.collect_list("_cell").alias("_field")).drop("_chunk")
    near = within_distance(
        steps.select(*[V.col(steps, c) for c in keys], "lat", "lon", V.number(steps, "wind_kt").alias("wind_kt")),
        moments.join(held, "moment_id").select(*[V.col(moments, c) for c in moments.columns], "_field"),
        cutoff_km=CUTOFF_FACTOR * bandwidth_km, history_lat="storm_lat", history_lon="storm_lon",
    )
    apart = F.col("distance_km") / F.lit(bandwidth_km)
    weight = F.exp(-0.5 * apart * apart)
    if use_wind:
        gap = (V.number(moments, "storm_wind") - F.col("wind_kt")) / F.lit(WIND_SCALE_KT)
        weight = weight * F.coalesce(F.exp(-0.5 * gap * gap), F.lit(1.0))
    weighted = near.withColumn("weight", weight)
    rows = weighted.select(*[F.col(f"`{c}`") for c in keys], "weight", F.inline("_field"))
    return weighted_aggregate(
        rows, value="rain_mm_h", weight="weight", group_by=[*keys, "cell_id"], thresholds=thresholds
    )
