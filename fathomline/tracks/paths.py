"""Tracks of points: clipping, features, path distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.functions.geo import great_circle_km, polar, similarity
from fathomline.operators.aggregate import circular_mean
from fathomline.operators.ordered import needs_blocks, over_rows, position
from fathomline.operators.rows import top_per_group
from fathomline.session import settle
from fathomline.tracks.neighbours import block_pairs, plain_frame
from fathomline.tracks.pruned import BOXES, pruned_top

# The reference point, km per degree there, and the island's outline.
CENTRE = (23.7, 121.0)
KM_LAT, KM_LON = 110.57, 111.32
OUTLINE = (
    (121.53, 25.30), (121.69, 25.16), (122.00, 25.01), (121.86, 24.85), (121.85, 24.60),
    (121.75, 24.13), (121.55, 23.78), (121.50, 23.40), (121.40, 23.10), (121.20, 22.80),
    (121.00, 22.45), (120.90, 22.00), (120.85, 21.90), (120.74, 21.93), (120.55, 22.30),
    (120.30, 22.55), (120.15, 22.95), (120.10, 23.30), (120.13, 23.70), (120.50, 24.30),
    (120.78, 24.65), (121.00, 25.00), (121.25, 25.13), (121.40, 25.28),
)
BUFFER_KM = (50.0, 2000.0)
CALM_PRESSURE = 1013.0
WINDWARD = math.radians(60.0)
STEP_HOURS = 3
NO_PLACE = ("", "---", "nan", "None")
# Scales and weights of the warped distance.
WARP_SCALE = {"r": 300.0, "theta": math.pi, "wind": 100.0, "pressure": 50.0}
WARP_PRESSURE, WARP_DECAY, WARP_BAND = 950.0, 200.0, 0.3
WARP_WEIGHTS = (1.0, 1.0, 1.0, 0.5)


def plane(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in km around the reference point."""
    wide = KM_LON * math.cos(math.radians(CENTRE[0]))
    return (lon - F.lit(CENTRE[1])) * F.lit(wide), (lat - F.lit(CENTRE[0])) * F.lit(KM_LAT)


def outline_km(lat: Column, lon: Column, outline=OUTLINE) -> Column:
    """Distance to a closed outline; 0 inside it.

    Two dozen edges per point outgrow a generated method and crawl as interpreted
    lambdas, so a batch of points meets all edges in numpy.
    """
    wide = KM_LON * math.cos(math.radians(CENTRE[0]))
    a = np.array([((e - CENTRE[1]) * wide, (n - CENTRE[0]) * KM_LAT) for e, n in outline])
    b = np.roll(a, -1, axis=0)

    @F.pandas_udf("double")
    def measured(x: pd.Series, y: pd.Series) -> pd.Series:
        p = np.column_stack([x.to_numpy(float), y.to_numpy(float)])
        out = np.empty(len(p))
        for i in range(0, len(p), 20_000):
            q = p[i:i + 20_000]
            px, py = q[:, :1], q[:, 1:]
            # An edge counts when it straddles the point's height to its right.
            low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
            rise = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
            lean = (b[:, 0] - a[:, 0]) / rise
            crossed = (py >= low) & (py < high) & (px < a[:, 0] + (py - a[:, 1]) * lean)
            inside = crossed.sum(axis=1) % 2 == 1
            out[i:i + 20_000] = np.where(inside, 0.0, _nearest(q, _segments(a, b)))
        return pd.Series(out)

    return measured(*plane(lat, lon))


def clip_tracks(
    df: DataFrame, *, track: str, order_by, buffer_km: float = 500.0, lat: str = "lat",
    lon: str = "lon", outline=OUTLINE, blocks: bool | None = None,
) -> DataFrame:
    """Points within the buffer; a track with under two keeps its nearest ones."""
    if not BUFFER_KM[0] <= buffer_km <= BUFFER_KM[1]:
        raise ValueError(f"buffer_km must lie between {BUFFER_KM[0]:g} and {BUFFER_KM[1]:g}")
    near = df.withColumn("_d", outline_km(V.col(df, lat), V.col(df, lon), outline))
    sizes = near.groupBy(V.col(df, track).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") <= buffer_km).alias("_inside")
    )
    joined = near.join(sizes, V.col(df, track) == F.col("_t"))
    inside = joined.where((F.col("_inside") >= 2) & (F.col("_d") <= buffer_km))
    # Few tracks come here, and of each only the nearest fifth of its points stays.
    far = position(
        joined.where(F.col("_inside") < 2), "_place", group_by=[track],
        order_by=["_d", *V.must_order(order_by)], blocks=blocks,
    ).where(F.col("_place") <= F.greatest(F.lit(2), F.floor(F.col("_n") / 5)))
    both = inside.unionByName(far.drop("_place"))
    return both.withColumnRenamed("_d", "outline_km").drop("_t", "_n", "_inside")


def track_features(
    df: DataFrame, *, track: str, time: str, order_by=None, lat: str = "lat", lon: str = "lon",
    wind: str = "wind_kt", pressure: str = "pressure_mb", place: str | None = None,
    centre=CENTRE, blocks: bool | None = None,
) -> DataFrame:
    """Eleven numbers per (clipped) track."""
    order = V.names(order_by) or [time]
    r, theta = polar(V.col(df, lat), V.col(df, lon), *centre)
    points = df.select(
        V.col(df, track), *[V.col(df, c) for c in dict.fromkeys([time, *order]) if c != track],
        V.col(df, lat).alias("_lat"), V.col(df, lon).alias("_lon"), r.alias("_r"), theta.alias("_th"),
        F.coalesce(V.number(df, wind), F.lit(0.0)).alias("_w"),
        F.coalesce(V.number(df, pressure), F.lit(CALM_PRESSURE)).alias("_p"),
        V.col(df, place).cast("string").alias("_place") if place else F.lit(None).cast("string").alias("_place"),
    )
    blocks = needs_blocks(points, [track], blocks)
    points = position(points, "_i", group_by=[track], order_by=order, blocks=blocks)
    points = over_rows(
        points,
        lambda w: {
            "_step": great_circle_km(
                F.lag("_lat").over(w), F.lag("_lon").over(w), F.col("_lat"), F.col("_lon")
            )
        },
        group_by=[track], order_by="_i", before=1, blocks=blocks,
    )
    sizes = points.groupBy(V.col(df, track).alias("_t")).agg(F.max("_i").alias("_n"))
    points = points.join(sizes, V.col(df, track) == F.col("_t")).drop("_t")
    at = V.moment(df, time)
    early = F.col("_i") <= F.greatest(F.lit(2), F.floor(F.col("_n") / 2))
    hours = (F.max(F.unix_micros(at)) - F.min(F.unix_micros(at))) / F.lit(3.6e9)
    steps = F.greatest(F.lit(1), (F.count(F.lit(1)) - 1) * STEP_HOURS)
    path = F.coalesce(F.sum("_step"), F.lit(0.0))
    facing = 0.5 + 0.5 * F.greatest(F.lit(0.0), F.cos(F.col("_th") - F.lit(WINDWARD)))
    first = F.min_by(F.struct("_lat", "_lon"), "_i")
    landed = F.max(F.col("_place").isNotNull() & ~F.trim("_place").isin(*NO_PLACE))
    out = points.groupBy(V.col(df, track)).agg(
        F.min("_r").alias("min_distance_km"),
        circular_mean(F.col("_th")).alias("mean_angle"),
        F.max("_w").alias("max_wind_kt"),
        F.max("_w").alias("max_wind_in_window_kt"),
        F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).when(hours > 0, path / hours).otherwise(path / steps)
        .alias("approach_speed_kmh"),
        F.coalesce(F.min(F.when(F.col("_p") < CALM_PRESSURE, F.col("_p"))), F.lit(CALM_PRESSURE))
        .alias("min_pressure_mb"),
        F.coalesce(
            F.regr_slope(F.when(early, F.col("_w")), F.when(early, F.col("_i").cast("double"))),
            F.lit(0.0),
        ).alias("intensification"),
        F.avg(F.col("_w") * facing / F.greatest(F.lit(1.0), F.col("_r"))).alias("rain_proxy"),
        landed.cast("double").alias("is_landfall"),
        first.alias("_first"),
    )
    return out.withColumns(
        {"entry_lon": F.col("_first._lon"), "entry_lat": F.col("_first._lat")}
    ).drop("_first")


FEATURES = (
    "min_distance_km", "mean_angle", "max_wind_kt", "max_wind_in_window_kt", "approach_speed_kmh",
    "min_pressure_mb", "intensification", "rain_proxy", "is_landfall", "entry_lon", "entry_lat",
)


# Distances worked on at once, so that the intermediate arrays stay in cache.
_CELLS = 65_536


def _segments(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, directions and inverse squared lengths of segments."""
    dx, dy = b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]
    length = dx * dx + dy * dy
    inverse = np.where(length > 1e-12, 1.0 / np.where(length > 1e-12, length, 1.0), 0.0)
    return a[:, 0].copy(), a[:, 1].copy(), dx, dy, inverse


def _squared(p: np.ndarray, lines: tuple[np.ndarray, ...]) -> np.ndarray:
    """(points, segments) squared distances."""
    ax, ay, dx, dy, inverse = lines
    gx, gy = p[:, :1] - ax, p[:, 1:] - ay
    t = gx * dx
    t += gy * dy
    t *= inverse
    np.clip(t, 0.0, 1.0, out=t)
    gx -= t * dx
    gy -= t * dy
    gx *= gx
    gy *= gy
    gx += gy
    return gx


def _nearest(p: np.ndarray, lines: tuple[np.ndarray, ...]) -> np.ndarray:
    """Distance of each point to its nearest segment."""
    step = max(1, _CELLS // max(1, len(lines[0])))
    return np.sqrt(np.concatenate(
        [_squared(p[i:i + step], lines).min(axis=1) for i in range(0, len(p), step)]
    ))


def path_distance(
    queries: DataFrame, tracks: DataFrame, *, track: str, order_by, k: int = 5, x: str = "x",
    y: str = "y", exclude_self: bool = True, blocks: bool | None = None,
) -> DataFrame:
    """Symmetric mean nearest-point distance of tracks, the k nearest per query.

    Where no track is hot, a track is one row, cells are cut by the middle of a track's box, and a query visits only the
    blocks whose boxes lie near enough (``pruned_top``); within a block a raster of distances bounds every pair before
    any is measured. A hot track is spread over blocks: each emits the sum of its own points' distances
    and the least distance to every query point, and an aggregation puts them together.
    """
    hot = needs_blocks(tracks, [track], blocks)
    kinds = f"query_id {V.kind(queries, track).simpleString()}, item_id {V.kind(tracks, track).simpleString()}"
    if not hot:
        known = settle(track_lines(tracks, track=track, order_by=order_by, x=x, y=y))
        asked = known if tracks is queries else track_lines(queries, track=track, order_by=order_by, x=x, y=y)
        length = known.agg(F.avg(F.size("_x"))).first()[0] or 1
        found = pruned_top(
            asked, known, k=k, kernel=lambda left, right: _raster_top(left, right, k, exclude_self),
            schema=f"{kinds}, distance double", space=BOXES, row_bytes=64 + 16 * int(length),
        )
        return found.withColumn("score", similarity(F.col("distance")))

    def segments(df: DataFrame) -> DataFrame:
        slim = df.select(
            V.col(df, track), *[V.col(df, o) for o in V.must_order(order_by)],
            V.number(df, x).alias("_x"), V.number(df, y).alias("_y"),
        )
        led = over_rows(
            slim,
            lambda w: {"_nx": F.lead("_x").over(w), "_ny": F.lead("_y").over(w)},
            group_by=[track], order_by=order_by, after=1, blocks=hot,
        )
        # The last point stands as a segment of no length.
        return led.select(
            V.col(df, track), "_x", "_y", F.coalesce("_nx", "_x").alias("_nx"),
            F.coalesce("_ny", "_y").alias("_ny"),
        )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(track, kind="stable")
        codes, names = pd.factorize(left[track])
        held = {
            "names": np.asarray(names),
            "points": left[["_x", "_y"]].to_numpy(),
            "lines": _segments(left[["_x", "_y"]].to_numpy(), left[["_nx", "_ny"]].to_numpy()),
            "heads": np.flatnonzero(np.r_[True, np.diff(codes) > 0]),
        }
        run = _spread(held, track, exclude_self)
        made = [x for x in (run(iter([right])) if len(left) and len(right) else ()) if len(x)]
        return plain_frame({n: np.concatenate([x[n].to_numpy() for x in made] or [np.zeros(0, object)]) for n in columns})

    columns = ["query_id", "item_id", "point", "value", "n"]
    own = F.col(f"`{track}`")
    # A query's own line stays whole; the others are too long for a task.
    found = block_pairs(
        segments(queries), segments(tracks), query_by=[own], item_by=[own, F.col("_x"), F.col("_y")],
        kernel=meet, schema=f"{kinds}, point int, value double, n bigint", row_bytes=80,
    )
    own = F.col("point") < 0
    per_point = found.groupBy("query_id", "item_id", "point").agg(
        F.min("value").alias("least"),
        (F.sum("value") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"),
    )
    found = per_point.groupBy("query_id", "item_id").agg(
        (0.5 * (F.max(F.when(own, F.col("mean"))) + F.avg(F.when(~own, F.col("least")))))
        .alias("distance")
    )
    ranked = top_per_group(
        found.withColumn("distance", F.round("distance", 9)), k=k, group_by="query_id",
        order_by="distance,item_id", output="rank",
    )
    return ranked.withColumn("rank", F.col("rank") - 1).withColumn(
        "score", similarity(F.col("distance"))
    )


def _measure(q: dict, a: np.ndarray, b: np.ndarray, heads: np.ndarray):
    """Per track: the sums of its points' distances to each query, and the least
    distance of each query point to it."""
    sums, least = [], []
    step = max(1, _CELLS // len(q["points"]))
    for i in range(0, len(a), step):
        near = np.minimum.reduceat(_squared(a[i:i + step], q["lines"]), q["heads"], axis=1)
        sums.append(np.sqrt(near))
    here = _segments(a, b)
    step = max(1, _CELLS // len(a))
    for i in range(0, len(q["points"]), step):
        near = np.minimum.reduceat(_squared(q["points"][i:i + step], here), heads, axis=1)
        least.append(np.sqrt(near))
    return np.add.reduceat(np.concatenate(sums), heads, axis=0), np.concatenate(least)


def _runs(batch: pd.DataFrame, track: str):
    codes, ids = pd.factorize(batch[track])
    order = np.argsort(codes, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
    counts = np.diff(np.r_[heads, len(order)])
    return (
        np.asarray(ids), batch[["_x", "_y"]].to_numpy()[order], batch[["_nx", "_ny"]].to_numpy()[order],
        heads, counts,
    )


def track_lines(df: DataFrame, *, track: str, order_by, x: str = "x", y: str = "y") -> DataFrame:
    """One row for each track: its points in order, its box, and the middle of the box."""
    order = F.struct(*[V.col(df, o).alias(f"o{i}") for i, o in enumerate(V.must_order(order_by))])
    point = F.struct(order.alias("o"), V.number(df, x).alias("x"), V.number(df, y).alias("y"))
    lines = df.groupBy(V.col(df, track).alias("_key")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    lines = lines.select("_key", F.col("p.x").alias("_x"), F.col("p.y").alias("_y"))
    boxed = lines.withColumns({f"_{c}{i}": f(f"_{c}") for c in "xy" for i, f in enumerate((F.array_min, F.array_max))})
    return boxed.withColumn("_at", F.array(*((F.col(f"_{c}0") + F.col(f"_{c}1")) / 2 for c in "xy")))


class _Lines:
    """Tracks of a block as one run of points."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("_key", kind="stable")
        self.names = rows["_key"].to_numpy(dtype=object)
        self.sizes = rows["_x"].map(len).to_numpy()
        self.heads = np.cumsum(self.sizes) - self.sizes
        self.points = np.column_stack([np.concatenate([np.asarray(v, float) for v in rows[c]]) for c in ("_x", "_y")])
        after = np.roll(self.points, -1, axis=0)
        last = self.heads + self.sizes - 1
        after[last] = self.points[last]
        self.lines = _segments(self.points, after)

    def __len__(self) -> int:
        return len(self.names)

    def span(self, low: int, high: int) -> slice:
        """Points of the tracks from low to high."""
        return slice(self.heads[low], self.heads[high - 1] + self.sizes[high - 1])


class _Raster:
    """Cells over the points that ask; a distance from a cell's middle is off by no more than the way to the middle.

    Where the points are few different ones, as on a grid, each is a cell of its own and nothing is off.
    """

    def __init__(self, own: _Lines, room: int) -> None:
        points = own.points
        # A field may cost a quarter of what measuring all pairs would, and few of its numbers are worked out twice.
        most = int(np.clip(len(points) / 4, 16, min(16_384, max(1024, room // len(own)))))
        single, cell = np.unique(points, axis=0, return_inverse=True)
        if len(single) <= most:
            self.middles, self.cell = single, cell.reshape(-1)
        else:
            side, low, high = int(most ** 0.5), points.min(0), points.max(0)
            step = np.maximum((high - low) / side, 1e-9)
            at = np.clip(((points - low) / step).astype(int), 0, side - 1)
            used, self.cell = np.unique(at[:, 0] * side + at[:, 1], return_inverse=True)
            self.middles = low + (np.column_stack([used // side, used % side]) + 0.5) * step
        off = np.hypot(*(points - self.middles[self.cell]).T)
        self.own, self.off = own, np.add.reduceat(off, own.heads) / own.sizes

    def field(self, other: _Lines, low: int, high: int) -> np.ndarray:
        """(cells, tracks) distances of the middles to some of the other tracks."""
        span = other.span(low, high)
        lines = tuple(v[span] for v in other.lines)
        heads = other.heads[low:high] - other.heads[low]
        out = np.empty((len(self.middles), high - low), np.float32)
        step = max(1, _CELLS // len(lines[0]))
        for i in range(0, len(out), step):
            out[i:i + step] = np.minimum.reduceat(_squared(self.middles[i:i + step], lines), heads, axis=1)
        return np.sqrt(out, out=out)

    def means(self, field: np.ndarray, low: int, high: int) -> np.ndarray:
        """(own tracks, tracks of the field) mean distances of some own tracks' middles."""
        heads, sizes = self.own.heads[low:high], self.own.sizes[low:high]
        out = np.empty((high - low, field.shape[1]), np.float32)
        if sizes.mean() > len(field) / 16:
            step = max(1, _FIELD // 4 // len(field))
            for i in range(0, len(out), step):
                some = sizes[i:i + step]
                at = self.cell[heads[i]:heads[i] + some.sum()] + np.repeat(np.arange(len(some)) * len(field), some)
                weight = np.bincount(at, minlength=len(some) * len(field)).reshape(len(some), -1) / some[:, None]
                np.matmul(weight.astype(np.float32), field, out=out[i:i + step])
            return out
        # Longest first, a few rows at a time that stay in cache: the next points of all that have one are added at once.
        order = np.argsort(-sizes, kind="stable")
        step = max(1, _CELLS // max(1, field.shape[1]))
        for i in range(0, len(out), step):
            some = order[i:i + step]
            first, many = heads[some], sizes[some]
            total = field[self.cell[first]]
            for j in range(1, many[0]):
                live = int(np.searchsorted(-many, -j, "left"))
                total[:live] += field[self.cell[first[:live] + j]]
            total /= many[:, None].astype(np.float32)
            out[some] = total
        return out


# Numbers of a raster field held at once, and of the bounds of pairs.
_FIELD = 16_000_000
_PAIRS = 2_000_000


def _mean_apart(q: _Lines, i: int, items: _Lines, some: np.ndarray) -> np.ndarray:
    """Symmetric mean nearest-point distances of one track to some of the items, to nine places."""
    mine = q.span(i, i + 1)
    sizes = items.sizes[some]
    heads = np.cumsum(sizes) - sizes
    at = np.repeat(items.heads[some] - heads, sizes) + np.arange(sizes.sum())
    there = np.sqrt(np.minimum.reduceat(_squared(q.points[mine], tuple(v[at] for v in items.lines)), heads, axis=1)).mean(0)
    back = np.add.reduceat(_nearest(items.points[at], tuple(v[mine] for v in q.lines)), heads) / sizes
    return np.round(0.5 * (there + back), 9)


def _raster_top(left: pd.DataFrame, right: pd.DataFrame, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k nearest tracks of a block for each query; only pairs whose bound lets them be among these are measured."""
    if not len(left) or not len(right):
        return plain_frame({"query_id": np.zeros(0, object), "item_id": np.zeros(0, object), "distance": np.zeros(0)})
    left = left.sort_values("_key", kind="stable")
    q, items = _Lines(left), _Lines(right)
    limit = left["_bound"].fillna(np.inf).to_numpy(dtype=float)
    best = [(np.zeros(0), np.zeros(0, int)) for _ in range(len(q))]
    to_items, to_queries = (_Raster(own, _FIELD) for own in (q, items))
    # A track is one item at most.
    self_at = pd.Index(items.names).get_indexer(pd.Index(q.names)) if exclude_self else np.full(len(q), -1)
    room = max(1, _FIELD // len(to_items.middles))
    for a in range(0, len(items), room):
        z = min(len(items), a + room)
        from_queries, off = to_items.field(items, a, z), 0.5 * to_queries.off[a:z].astype(np.float32)
        rows = max(1, min(_PAIRS // (z - a), _FIELD // len(to_queries.middles)))
        for low in range(0, len(q), rows):
            high = min(len(q), low + rows)
            far = to_items.means(from_queries, low, high)
            far += to_queries.means(to_queries.field(q, low, high), a, z).T
            far *= np.float32(0.5)
            own = np.flatnonzero((self_at[low:high] >= a) & (self_at[low:high] < z))
            far[own, self_at[low + own] - a] = np.inf
            # Sums of single precision; a product adds up a number for each cell.
            slack = 1e-7 * (8 + max(q.sizes[low:high].max(), items.sizes[a:z].max(), len(to_items.middles), len(to_queries.middles)))
            own_off = 0.5 * to_items.off[low:high]
            edge = limit[low:high].copy()
            for i in range(low, high):
                if len(best[i][0]) >= k:
                    edge[i - low] = min(edge[i - low], best[i][0][k - 1])
            free = np.flatnonzero(~np.isfinite(edge))
            if len(free) and z - a > k:
                least = np.partition(far[free] * np.float32(1 + slack) + off, k - 1, axis=1)[:, k - 1]
                edge[free] = least * (1 + slack) + own_off[free]
            # What the k nearest keep at most, against what a pair keeps at least.
            most = np.minimum((edge + own_off + 1e-8) * (1 + 1e-6), np.finfo(np.float32).max).astype(np.float32)
            far *= np.float32(1 - slack)
            far -= off
            at, which = np.nonzero(far <= most[:, None])
            starts = np.searchsorted(at, np.arange(high - low + 1))
            for i in np.flatnonzero(np.diff(starts)):
                some = which[starts[i]:starts[i + 1]]
                least = far[i, some]
                order = np.argsort(least, kind="stable")
                some, least = some[order], least[order] - own_off[i]
                for part in (slice(0, 2 * k), slice(2 * k, None)):
                    dist, who = best[low + i]
                    keep = least[part] <= min(limit[low + i], dist[k - 1] if len(dist) >= k else np.inf) * (1 + 1e-6) + 1e-8
                    near = some[part][keep]
                    for c in range(0, len(near), 256):
                        dist = np.concatenate([dist, _mean_apart(q, low + i, items, near[c:c + 256] + a)])
                        who = np.concatenate([who, near[c:c + 256] + a])
                        first = np.lexsort((who, dist))[:k]
                        dist, who = dist[first], who[first]
                    best[low + i] = dist, who
    found = [len(w) for _, w in best]
    return plain_frame({
        "query_id": np.repeat(q.names, found), "item_id": items.names[np.concatenate([w for _, w in best])],
        "distance": np.concatenate([d for d, _ in best]),
    })


def _spread(held, track: str, exclude_self: bool):
    """Tasks that see parts of tracks: what each part adds, for an aggregation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = held
        names = q["names"]
        of = np.repeat(np.arange(len(names)), np.diff(np.r_[q["heads"], len(q["points"])]))
        place = np.arange(len(of)) - q["heads"][of]
        for batch in batches:
            if not len(batch):
                continue
            ids, a, b, heads, counts = _runs(batch, track)
            sums, least = _measure(q, a, b, heads)
            for j, item in enumerate(ids):
                pick = names != item if exclude_self else np.ones(len(names), dtype=bool)
                points = pick[of]
                yield pd.DataFrame({
                    "query_id": np.r_[names[pick], names[of[points]]],
                    "item_id": item,
                    "point": np.r_[np.full(pick.sum(), -1), place[points]],
                    "value": np.r_[sums[j][pick], least[points, j]],
                    "n": np.r_[np.full(pick.sum(), counts[j]), np.zeros(points.sum(), dtype=int)],
                })

    return run


def warp_points(
    df: DataFrame, *, lat: str = "lat", lon: str = "lon", wind: str = "wind_kt",
    pressure: str = "pressure_mb", centre=CENTRE,
) -> DataFrame:
    """The four scaled and distance-weighted coordinates a warped distance compares."""
    r, theta = polar(V.col(df, lat), V.col(df, lon), *centre)
    w = F.coalesce(V.number(df, wind), F.lit(0.0))
    p = F.coalesce(V.number(df, pressure), F.lit(CALM_PRESSURE))
    near = F.exp(-r / F.lit(WARP_DECAY))
    scaled = [
        r / F.lit(WARP_SCALE["r"]), theta / F.lit(WARP_SCALE["theta"]), w / F.lit(WARP_SCALE["wind"]),
        (p - F.lit(WARP_PRESSURE)) / F.lit(WARP_SCALE["pressure"]),
    ]
    return df.withColumn("warp", F.array(*[c * near for c in scaled]))


def warp(a: np.ndarray, b: np.ndarray, weights=WARP_WEIGHTS) -> float:
    """Time-warped distance of two (points, 4) sequences inside a 30 % band."""
    return float(warp_many([a], [b], weights)[0])


def warp_many(left: list[np.ndarray], right: list[np.ndarray], weights=WARP_WEIGHTS) -> np.ndarray:
    """Time-warped distances of pairs of (points, 4) sequences inside a 30 % band.

    Cells of one anti-diagonal depend only on the two before it, so each is one
    numpy step for all pairs and only three diagonals are held.
    """
    n, m = np.array([len(a) for a in left]), np.array([len(b) for b in right])
    w = np.asarray(weights, dtype=float) / np.sum(weights)
    band = np.maximum(1, (WARP_BAND * np.maximum(n, m)).astype(int))
    deep, wide = int(n.max(initial=0)), int(m.max(initial=0))
    a, b = np.zeros((len(left), deep + 1, 4)), np.zeros((len(right), wide + 1, 4))
    for p, (x, y) in enumerate(zip(left, right)):
        a[p, 1:len(x) + 1], b[p, 1:len(y) + 1] = np.reshape(x, (-1, 4)), np.reshape(y, (-1, 4))
    older, old = (np.full((len(left), deep + 1), np.inf) for _ in "ab")
    older[:, 0] = 0.0
    out = np.full(len(left), np.inf)
    for s in range(2, deep + wide + 1):
        new = np.full_like(old, np.inf)
        i = np.arange(max(1, s - wide), min(deep, s - 1) + 1)
        i = i[np.abs(2 * i - s) <= band.max()]
        if len(i):
            gap = np.abs(a[:, i] - b[:, s - i])
            gap[:, :, 1] = np.minimum(gap[:, :, 1], 2 * math.pi - gap[:, :, 1])
            before = np.minimum(np.minimum(old[:, i - 1], old[:, i]), older[:, i - 1])
            inside = (np.abs(2 * i - s) <= band[:, None]) & (i <= n[:, None]) & (s - i <= m[:, None])
            new[:, i] = np.where(inside, (w * gap * gap).sum(2) + before, np.inf)
        older, old = old, new
        ends = np.flatnonzero((n + m == s) & (n > 0) & (m > 0))
        out[ends] = np.sqrt(old[ends, n[ends]] / s)
    return out


# Points of padded tracks whose pairs are warped together.
_WARPED = 65_536


def _warped(left: pd.Series, right: pd.Series) -> pd.Series:
    a, b = ([np.stack([np.asarray(p) for p in v]) if len(v) else np.zeros((0, 4)) for v in side] for side in (left, right))
    out = np.full(len(a), np.inf)
    # Pairs of like length stand together, so that little is padded.
    order = sorted(range(len(a)), key=lambda i: (len(a[i]) + len(b[i]), len(a[i])))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (len(a[order[to]]) + len(b[order[to]])) <= _WARPED:
            to += 1
        some = order[at:to]
        out[some] = warp_many([a[i] for i in some], [b[i] for i in some])
        at = to
    return pd.Series(out)


def warped_distance(
    pairs: DataFrame, points: DataFrame, *, track: str, order_by
) -> DataFrame:
    """Warped distance of candidate pairs (query_id, item_id), ranked per query.

    Comparing two tracks is sequential in both, so pairs of like length
    go through it together, a bounded number of points at a time.
    """
    order = F.struct(*[V.col(points, o) for o in V.must_order(order_by)])
    lines = points.groupBy(V.col(points, track).alias("_t")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("warp").alias("w")))),
            lambda e: e["w"],
        ).alias("line")
    )

    measured = F.pandas_udf(_warped, "double")
    a = lines.select(F.col("_t").alias("query_id"), F.col("line").alias("_a"))
    b = lines.select(F.col("_t").alias("item_id"), F.col("line").alias("_b"))
    both = pairs.select("query_id", "item_id").join(a, "query_id").join(b, "item_id")
    scored = both.select("query_id", "item_id", measured("_a", "_b").alias("distance")).where(
        F.col("distance") < math.inf
    )
    ranked = top_per_group(
        scored, k=2**31 - 1, group_by="query_id", order_by="distance,item_id", output="rank"
    )
    return ranked.withColumn("rank", F.col("rank") - 1)
