"""Classes 1 to 9 of a track from its geometry and where it came ashore."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.functions.geo import great_circle_km
from fathomline.operators.ordered import needs_blocks, over_rows, position
from fathomline.tracks.neighbours import Found, exact, own_edge, rough_squares, scan_top
from fathomline.tracks.pruned import Cells, Space, ball_bound
from fathomline.tracks.paths import CENTRE

# Distances in km, meridians and parallels the classes are cut at.
CONTEXT_KM, ASHORE_KM, WEST_KM = 500.0, 100.0, 400.0
WEST_LON, EAST_LON, MIDDLE_LAT = 120.3, 121.8, 23.5
NO_LANDFALL = ("", "---", "nan", "None", "無登陸")
# Place words by coast, and the combinations read before single words.
EAST_NORTH = ("基隆", "宜蘭", "彭佳嶼", "蘇澳", "頭城", "三貂角", "新北", "淡水", "南澳", "蘭陽", "秀林")
EAST_CENTRAL = ("花蓮", "新港", "成功", "秀姑巒", "豐濱", "長濱", "靜浦", "東澳", "東河")
EAST_SOUTH = ("臺東", "台東", "大武", "太麻里", "滿州", "鵝鑾鼻")
WEST_SOUTH = ("金門", "高雄", "小港", "東石", "台中", "臺中", "苗栗", "彰化", "雲林", "嘉義")
SOUTH_TIP = ("恆春", "屏東", "楓港", "枋寮")
FIRST_NORTH = ("宜蘭",)
FIRST_CENTRAL = ("豐濱", "長濱", "靜浦", "成功", "新港", "花蓮", "秀林")
WEIGHTS = {"feature": 0.4, "class": 0.5, "intensity": 0.1}


def landfall_zone(place: Column) -> Column:
    """The coast a landfall text names; null without one."""
    def names(words) -> Column:
        return place.rlike("|".join(words))

    return (
        F.when(place.isNull() | F.trim(place).isin(*NO_LANDFALL), F.lit(None).cast("string"))
        .when(names(FIRST_NORTH), "east_north")
        .when(names(FIRST_CENTRAL), "east_central")
        .when(names(EAST_SOUTH), "east_south")
        .when(names(SOUTH_TIP), "south_tip")
        .when(names(WEST_SOUTH), "west_south")
        .when(names(EAST_NORTH), "east_north")
        .when(names(EAST_CENTRAL), "east_central")
    )


def crossing_features(
    df: DataFrame, *, track: str, order_by, lat: str = "lat", lon: str = "lon",
    place: str | None = None, blocks: bool | None = None,
) -> DataFrame:
    """Closest point, entry and exit of the 500 km circle, headings, westward crossing."""
    order = V.must_order(order_by)
    points = df.select(
        V.col(df, track).alias("_t"), *[V.col(df, o).alias(f"_o{i}") for i, o in enumerate(order)],
        V.col(df, lat).alias("_lat"), V.col(df, lon).alias("_lon"),
        great_circle_km(V.col(df, lat), V.col(df, lon), F.lit(CENTRE[0]), F.lit(CENTRE[1])).alias("_d"),
        V.col(df, place).cast("string").alias("_place") if place else F.lit(None).cast("string").alias("_place"),
    )
    blocks = needs_blocks(points, ["_t"], blocks)
    points = position(
        points, "_i", group_by=["_t"], order_by=[f"_o{i}" for i in range(len(order))], blocks=blocks
    )
    near = F.col("_d") < CONTEXT_KM
    spot = F.struct("_lat", "_lon")
    whole = points.groupBy("_t").agg(
        F.max("_i").alias("_n"),
        F.min_by(F.struct("_i", "_lat", "_lon", "_d"), F.struct("_d", "_i")).alias("_c"),
        F.count_if(near).alias("context_points"),
        F.min_by(spot, F.when(near, F.col("_i"))).alias("_in"),
        F.max_by(spot, F.when(near, F.col("_i"))).alias("_out"),
        F.avg(F.when(near, (F.col("_lon") > F.lit(EAST_LON - 0.5)).cast("double"))).alias("east_ratio"),
        F.max("_place").alias("place"),
    )
    # Steps into the closest point; with under two of them, those around it.
    c = F.col("_c._i")
    short = (c - F.greatest(F.lit(1), c - 8)) < 2
    ends = whole.select(
        F.col("_t").alias("_k"), c.alias("_ci"),
        F.when(short, F.greatest(F.lit(1), c - 3)).otherwise(F.greatest(F.lit(1), c - 8)).alias("_from"),
        F.when(short, F.least(F.col("_n"), c + 3)).otherwise(c).alias("_to"),
    )
    stepped = over_rows(
        points,
        lambda w: {
            "_dlat": F.col("_lat") - F.lag("_lat").over(w),
            "_dlon": (F.col("_lon") - F.lag("_lon").over(w)) * F.cos(F.radians(F.lag("_lat").over(w))),
        },
        group_by=["_t"], order_by="_i", before=1, blocks=blocks,
    ).join(ends, F.col("_t") == F.col("_k"))
    step = (F.col("_i") > F.col("_from")) & (F.col("_i") <= F.col("_to"))
    after = (F.col("_i") >= F.col("_ci") - 3) & (F.col("_d") < WEST_KM)
    moving = stepped.groupBy("_k").agg(
        F.coalesce(
            F.degrees(F.atan2(F.avg(F.when(step, F.col("_dlat"))), F.avg(F.when(step, F.col("_dlon"))))),
            F.lit(0.0),
        ).alias("approach_heading"),
        F.coalesce(F.max(after & (F.col("_lon") < WEST_LON)), F.lit(False)).alias("crossed_to_west"),
    )
    heading = F.degrees(
        F.atan2(
            F.col("_out._lat") - F.col("_in._lat"),
            (F.col("_out._lon") - F.col("_in._lon")) * F.cos(F.radians(F.col("_in._lat"))),
        )
    )
    return whole.join(moving, F.col("_t") == F.col("_k")).select(
        F.col("_t").alias(track),
        F.col("_c._d").alias("min_distance_km"),
        F.col("_c._lat").alias("closest_lat"),
        F.col("_c._lon").alias("closest_lon"),
        "context_points",
        F.col("_in._lat").alias("entry_lat"),
        F.col("_out._lat").alias("exit_lat"),
        F.col("_out._lon").alias("exit_lon"),
        heading.alias("context_heading"),
        "approach_heading", "crossed_to_west", "east_ratio", "place",
    )


def classify(features: DataFrame) -> DataFrame:
    """Adds track_class and confidence: the first of an ordered list of rules."""
    d, lat, lon = F.col("min_distance_km"), F.col("closest_lat"), F.col("closest_lon")
    head, approach, west = F.col("context_heading"), F.col("approach_heading"), F.col("crossed_to_west")
    entry, exit_ = F.col("entry_lat"), F.col("exit_lat")
    told = F.col("place").isNotNull() & ~F.trim("place").isin(*NO_LANDFALL)
    zone = F.col("landfall_zone")
    sure = F.greatest(F.lit(0.4), F.least(F.lit(0.95), 1.0 - d / 500.0))
    along_east = (
        ~west & (lon > 120.8) & (head > 50) & (head < 125) & (lat < 26.0) & (F.col("east_ratio") > 0.3)
        & ~((approach > 145) & (d < 60))
        & ~(F.coalesce(zone == "east_north", F.lit(False)) & (d < 80))
        & ~(F.coalesce(zone == "east_central", F.lit(False)) & (d < 50) & (approach > 120))
        & ~((lat > 25.0) & (d > 200))
    )
    from_south = (
        (entry < 22.5) & (head < 80) & ~west & (lon > 120.5) & (lat < 24.0) & (d > 60)
    )
    rising = (entry < 22.5) & (head > 60)
    up_west = (entry < 22.0) & (lon < 121.0) & (head > 70) & (head < 140) & (exit_ > entry + 3.0)
    # (condition, class, share of the confidence); the first that holds decides.
    rules = [
        ((F.col("context_points") < 2) & (lat > MIDDLE_LAT), "1", None),
        (F.col("context_points") < 2, "5", None),
        (along_east, "6", 1.0),
        (from_south, "8", 1.0),
        (zone == "east_north", "2", 1.0),
        (zone == "east_central", "3", 1.0),
        (zone == "east_south", "4", 1.0),
        ((zone == "west_south") & rising & (exit_ > entry + 2.5), "7", 1.0),
        (zone == "west_south", "9", 0.7),
        ((zone == "south_tip") & rising & (exit_ > entry + 3.0), "7", 1.0),
        (zone == "south_tip", "4", 0.8),
        (up_west, "7", 1.0),
        (told & (lat >= 24.0), "2", 0.8),
        (told & (lat <= 22.8), "4", 0.8),
        (told, "3", 0.8),
        ((d > ASHORE_KM) & (lat > MIDDLE_LAT), "1", 1.0),
        (d > ASHORE_KM, "5", 1.0),
        (lat >= 24.0, "2", 0.7),
        (lat <= 22.5, "4", 0.7),
    ]
    name, trust = None, None
    for hit, label, share in rules:
        given = F.lit(0.4) if share is None else sure * F.lit(share)
        name = F.when(hit, F.lit(label)) if name is None else name.when(hit, F.lit(label))
        trust = F.when(hit, given) if trust is None else trust.when(hit, given)
    zoned = features.withColumn("landfall_zone", landfall_zone(F.col("place")))
    return zoned.withColumns(
        {"track_class": name.otherwise(F.lit("3")), "confidence": trust.otherwise(sure * 0.7)}
    )


def rule_similarity(
    queries: DataFrame, items: DataFrame, *, key: str, vector: str, label: str, wind: str, k: int = 5,
    weights: dict | None = None,
) -> DataFrame:
    """Feature distance, class mismatch and wind difference as one weighted distance."""
    w = {**WEIGHTS, **(weights or {})}

    def slim(df: DataFrame) -> DataFrame:
        return df.select(
            V.col(df, key), V.col(df, vector).cast("array<double>").alias("vector"),
            V.col(df, label).cast("string").alias("cls"), V.number(df, wind).alias("wind"),
        )

    def far(q: dict, it: dict, _k: int) -> Found:
        rough, off = rough_squares(q, it)
        rough[q["self"]] = -np.inf
        # The farthest known so far is the bound, less than nothing.
        edge = np.fmax(np.fmax.reduce(rough, axis=1, initial=-np.inf), np.where(np.isfinite(q["bound"]), q["bound"], 0.0) ** 2)
        rows, cols = np.nonzero(rough >= (edge - 1e-9 * np.abs(edge) - 2 * off)[:, None])
        return rows, cols, -exact(q, it, rows, cols)

    # The farthest candidate of a query scales its feature distances.
    asked, known = slim(queries), slim(items)
    row_bytes = 8 * (known.agg(F.max(F.size("vector"))).first()[0] or 1) + 64
    outward = Space(lambda d, rows, cells: -(d + cells.high) * (1 + 1e-6) - 1e-6)
    reach = scan_top(asked, known, key=key, columns=["vector"], at="vector", space=outward, kernel=far, k=1, row_bytes=row_bytes).select(
        F.col("query_id").alias(key), (-F.col("distance")).alias("reach")
    )

    def rest(q: dict, it: dict, rows, cols) -> np.ndarray:
        """What class and wind add to the distance of pairs."""
        gap = np.minimum(np.abs(q["wind"][rows] - it["wind"][cols]) / 100.0, 1.0)
        return w["class"] * (q["cls"][rows] != it["cls"][cols]) + w["intensity"] * gap

    def mixed(q: dict, it: dict, k: int) -> Found:
        rough, off = rough_squares(q, it)
        rough[q["self"]] = np.inf
        kinds = pd.factorize(np.concatenate([q["cls"], it["cls"]]), use_na_sentinel=False)[0]
        q, it = {**q, "cls": kinds[:len(rough)]}, {**it, "cls": kinds[len(rough):]}
        reach = q["reach"] + 1e-8

        def score(free: np.ndarray) -> np.ndarray:
            out = np.sqrt(np.maximum(rough[free], 0.0))
            out *= (w["feature"] / reach[free])[:, None]
            out += rest(q, it, free[:, None], np.arange(rough.shape[1])[None])
            return np.nan_to_num(out, nan=np.inf, posinf=np.inf)

        edge = own_edge(q["bound"], k, score)
        edge = edge + 1e-6 * (1.0 + np.abs(np.where(np.isfinite(edge), edge, 0.0)))
        found = []
        # The winds only add, so vectors of either class tell what may be near enough.
        for kind in np.unique(it["cls"]):
            where = np.flatnonzero(it["cls"] == kind)
            room = edge - w["class"] * (q["cls"] != kind)
            with np.errstate(divide="ignore"):
                most = np.where(room >= 0, (room * reach / w["feature"]) ** 2 * (1 + 1e-9) + 2 * off, -np.inf)
            mine = np.flatnonzero(most > -np.inf)
            rows, cols = np.nonzero(rough[np.ix_(mine, where)] <= np.minimum(most[mine], np.finfo(float).max)[:, None])
            found.append((mine[rows], where[cols]))
        rows, cols = (np.concatenate(x) for x in zip(*found))
        return rows, cols, w["feature"] * exact(q, it, rows, cols) / reach[rows] + rest(q, it, rows, cols)

    def least(d: np.ndarray, rows: dict, cells: Cells) -> np.ndarray:
        return w["feature"] * ball_bound(d, rows, cells) / (rows["reach"][:, None] + 1e-8)

    return scan_top(
        asked.join(reach, key), known, key=key, columns=["vector", "cls", "wind"], at="vector",
        space=Space(least, ("reach",)), kernel=mixed, k=k, row_bytes=row_bytes,
    )
