"""Similarity, votes, tracks and rain; tracks are the events of a user in time order."""

import math

from pyspark.sql import functions as F

from fathomline.catalog.base import Catalog, table
from fathomline.catalog.rows import PLACES, hav_sql, places
from fathomline.operators.windows import arc_points
from fathomline.plans.compose import run_plan
from fathomline.session import settle
from fathomline.tracks import classes, climatology, neighbours, paths, rainfall

C = Catalog()

_D = "sqrt(list_sum(list_transform(list_zip(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _knn_sql(source, k):
    return f"""SELECT a.id AS query_id, b.id AS item_id, {_D} AS distance,
       row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) - 1 AS rank
       FROM ({source}) a JOIN ({source}) b ON a.id <> b.id QUALIFY rank < {k}"""


EMB = "SELECT vec_id AS id, embedding AS e FROM embeddings"
HEAD = "SELECT vec_id AS id, embedding[1:16] AS e FROM embeddings"


def embeddings(s, d):
    e = table(s, d, "embeddings")
    return e.withColumn("head", F.slice("embedding", 1, 16))


@C.add("nearest", f"""SELECT query_id, item_id, rank, round(distance, 6) AS distance,
       round(1 - distance / (max(distance) OVER (PARTITION BY query_id) + 1e-8), 5) AS score FROM ({_knn_sql(EMB, 5)})""")
def _(s, d):
    e = embeddings(s, d)
    out = neighbours.nearest(e, e, key="vec_id", vector="embedding", k=5)
    return out.select("query_id", "item_id", "rank", F.round("distance", 6).alias("distance"),
                      F.round("score", 5).alias("score"))


def _fused(s, d, k=5):
    e = embeddings(s, d)
    n = e.count()
    pool = neighbours.pool_size(n, k, neighbours.PATH_POOL)
    whole = neighbours.nearest(e, e, key="vec_id", vector="embedding", k=pool)
    head = neighbours.nearest(e, e, key="vec_id", vector="head", k=pool)
    return neighbours.path_fusion(whole, head, items=n, k=k)


_FUSE = f"""n AS (SELECT least(count(*) - 1, 60) AS p FROM embeddings), w AS ({_knn_sql(EMB, 60)}), h AS ({_knn_sql(HEAD, 60)}),
    u AS (SELECT coalesce(w.query_id, h.query_id) AS query_id, coalesce(w.item_id, h.item_id) AS item_id,
      round(0.8 / (60 + coalesce(w.rank, p)) + 0.2 / (60 + coalesce(h.rank, p)), 12) AS f
      FROM n, w FULL JOIN h ON w.query_id = h.query_id AND w.item_id = h.item_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, item_id) - 1 AS rank FROM u QUALIFY rank < 5),
    z AS (SELECT *, 1 - f / (max(f) OVER (PARTITION BY query_id) + 1e-8) AS distance FROM r)"""


@C.add("fuse_ranks", f"""WITH {_FUSE.replace("FROM n, w FULL JOIN h", "FROM w FULL JOIN h").replace("AND w.item_id = h.item_id)", "AND w.item_id = h.item_id CROSS JOIN n)")}
       SELECT query_id, item_id, rank, round(f, 9) AS fused, round(distance, 6) AS distance FROM z""")
def _(s, d):
    return _fused(s, d).select("query_id", "item_id", "rank", F.round("fused", 9).alias("fused"),
                               F.round("distance", 6).alias("distance"))


_VOTE = f"""k AS ({_knn_sql(EMB, 5)}), v AS (SELECT query_id, label, sum(exp(-distance)) AS w, min(rank) AS r
    FROM k JOIN embeddings ON item_id = vec_id GROUP BY ALL),
    t AS (SELECT query_id, arg_max(label, (round(w, 12), -r)) AS predicted, max(w) / sum(w) AS confidence FROM v GROUP BY 1)"""


def _voted(s, d):
    e = embeddings(s, d)
    near = neighbours.nearest(e, e, key="vec_id", vector="embedding", k=5)
    return e, neighbours.vote(near, e, key="vec_id", label="label")


@C.add("analog_vote", f"WITH {_VOTE} SELECT query_id, predicted, round(confidence, 6) AS confidence FROM t")
def _(s, d):
    return _voted(s, d)[1].withColumn("confidence", F.round("confidence", 6))


@C.add("leave_one_out", f"""WITH {_VOTE}, j AS (SELECT CAST(label AS VARCHAR) AS class, count(*) AS total,
         CAST(count_if(label = predicted) AS BIGINT) AS correct FROM t JOIN embeddings ON query_id = vec_id GROUP BY 1)
       SELECT class, total, correct, round(correct / total, 6) AS accuracy FROM j
       UNION ALL SELECT '(overall)', CAST(sum(total) AS BIGINT), CAST(sum(correct) AS BIGINT), round(sum(correct) / sum(total), 6) FROM j
       UNION ALL SELECT '(macro)', CAST(sum(total) AS BIGINT), CAST(sum(correct) AS BIGINT), round(avg(correct / total), 6) FROM j""")
def _(s, d):
    e, votes = _voted(s, d)
    return neighbours.leave_one_out(votes, e, key="vec_id", label="label")[1]


def _draw_sql(column: str, salt: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {column}, '{42 + salt}')), 1, 15) AS BIGINT)"


@C.add("random_analogs", f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
       s AS (SELECT i, list_filter(range(greatest(1, n * (2 * i + 1) // 128), greatest(1, n * (2 * i + 1) // 128) + 200), lambda s: gcd(s, n) = 1)[1] AS step
         FROM n, range(64) t(i)),
       p AS (SELECT vec_id AS item_id, row_number() OVER (ORDER BY {_draw_sql("vec_id", 0)}, vec_id) - 1 AS place FROM embeddings),
       d AS (SELECT vec_id AS query_id, j, ({_draw_sql("vec_id", 2)} % n + j * step) % n AS place
         FROM embeddings, n, range(6) t(j) JOIN s ON s.i = {_draw_sql("vec_id", 1)} % 64)
       SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY j) - 1 AS rank
       FROM d JOIN p USING (place) WHERE query_id <> item_id QUALIFY rank < 5""")
def _(s, d):
    e = table(s, d, "embeddings")
    return neighbours.random_analogs(e, e, key="vec_id", k=5)


@C.add("difference_ranks", """WITH v AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS v FROM supplier)
       SELECT a.id AS query_id, b.id AS item_id, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.v - b.v) NULLS LAST, b.id) - 1 AS rank
       FROM v a JOIN v b ON a.id <> b.id WHERE a.v IS NOT NULL QUALIFY rank < 10""")
def _(s, d):
    sup = table(s, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("rain")
    )
    out = neighbours.difference_ranks(sup, sup, key="s_suppkey", value="rain", k=10)
    return out.select("query_id", "item_id", "rank")


@C.add("rule_ranks", """SELECT a.vec_id AS query_id, b.vec_id AS item_id,
       row_number() OVER (PARTITION BY a.vec_id ORDER BY a.label <> b.label, b.vec_id) - 1 AS rank
       FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank < 60""")
def _(s, d):
    e = table(s, d, "embeddings")
    return neighbours.rule_ranks(e, e, key="vec_id", label="label", k=60)


# ---------------------------------------------------------------- tracks
def points(s, d):
    value = F.col("value")
    return table(s, d, "events").select(
        F.col("user_id").alias("track"), "ts", "event_id",
        (F.lit(18.0) + F.pmod(F.col("event_id") * 37, F.lit(131)) / 10.0).alias("lat"),
        (F.lit(115.0) + F.pmod(F.col("event_id") * 91, F.lit(119)) / 10.0).alias("lon"),
        value.alias("wind_kt"), (F.lit(1020.0) - value / 5.0).alias("pressure_mb"),
        F.when(value > 500, "花蓮").when(value > 400, "高雄").when(value > 350, "宜蘭縣")
        .when(value > 320, "恆春").when(value > 300, "臺東").alias("place"),
    )


POINTS = """(SELECT user_id AS track, ts, event_id, 18.0 + CAST((event_id * 37) % 131 AS DOUBLE) / 10.0 AS lat,
    115.0 + CAST((event_id * 91) % 119 AS DOUBLE) / 10.0 AS lon, value AS wind, 1020.0 - value / 5.0 AS pressure,
    CASE WHEN value > 500 THEN '花蓮' WHEN value > 400 THEN '高雄' WHEN value > 350 THEN '宜蘭縣' WHEN value > 320 THEN '恆春'
    WHEN value > 300 THEN '臺東' END AS place FROM events)"""


def _outline_sql():
    wide = paths.KM_LON * math.cos(math.radians(paths.CENTRE[0]))
    corners = [((a - 121.0) * wide, (b - 23.7) * paths.KM_LAT) for a, b in paths.OUTLINE]
    sides, inside = [], []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        dx, dy = bx - ax, by - ay
        t = f"greatest(0, least(1, ((x - ({ax!r})) * ({dx!r}) + (y - ({ay!r})) * ({dy!r})) / {dx * dx + dy * dy!r}))"
        sides.append(f"pow(x - ({ax!r}) - {t} * ({dx!r}), 2) + pow(y - ({ay!r}) - {t} * ({dy!r}), 2)")
        if ay != by:
            inside.append(
                f"CASE WHEN y >= {min(ay, by)!r} AND y < {max(ay, by)!r} AND x < ({ax!r}) + (y - ({ay!r})) * ({dx / dy!r}) THEN 1 ELSE 0 END"
            )
    return f"CASE WHEN ({' + '.join(inside)}) % 2 = 1 THEN 0.0 ELSE sqrt(least({', '.join(sides)})) END"


_WIDE = paths.KM_LON * math.cos(math.radians(paths.CENTRE[0]))
CLIP = f"""o AS (SELECT *, (lon - 121.0) * {_WIDE!r} AS x, (lat - 23.7) * {paths.KM_LAT} AS y FROM {POINTS}),
    k AS (SELECT *, {_outline_sql()} AS dist FROM o),
    g AS (SELECT *, count(*) OVER (PARTITION BY track) AS n, count(*) FILTER (dist <= 150) OVER (PARTITION BY track) AS ins,
      row_number() OVER (PARTITION BY track ORDER BY dist, ts, event_id) AS near FROM k),
    c AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ts, event_id) AS i FROM g
      WHERE (ins >= 2 AND dist <= 150) OR (ins < 2 AND near <= greatest(2, n // 5)))"""


def clipped(s, d):
    return paths.clip_tracks(points(s, d), track="track", order_by="ts,event_id", buffer_km=150)


@C.add("clip_tracks", f"WITH {CLIP} SELECT track, event_id, round(dist, 6) AS outline_km FROM c")
def _(s, d):
    return clipped(s, d).select("track", "event_id", F.round("outline_km", 6).alias("outline_km"))


_R = hav_sql("lat", "lon", "23.7", "121.0")
FEATURES = f"""p AS (SELECT *, {_R} AS r, atan2(lat - 23.7, (lon - 121.0) * cos(radians(lat))) AS th, lag(lat) OVER w AS la, lag(lon) OVER w AS lo,
      max(i) OVER (PARTITION BY track) AS m FROM c WINDOW w AS (PARTITION BY track ORDER BY i)),
    f AS (SELECT track, min(r) AS min_distance_km, atan2(avg(sin(th)), avg(cos(th))) AS mean_angle, max(wind) AS max_wind_kt,
      max(wind) AS max_wind_in_window_kt, coalesce(sum({hav_sql('la', 'lo', 'lat', 'lon')}), 0) / CASE WHEN max(ts) > min(ts)
        THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 ELSE greatest(1, (count(*) - 1) * 3) END AS approach_speed_kmh,
      coalesce(min(CASE WHEN pressure < 1013 THEN pressure END), 1013.0) AS min_pressure_mb,
      coalesce(regr_slope(wind, i) FILTER (i <= greatest(2, m // 2)), 0) AS intensification,
      avg(wind * (0.5 + 0.5 * greatest(0, cos(th - radians(60)))) / greatest(1, r)) AS rain_proxy,
      CAST(max(CASE WHEN place IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) AS is_landfall,
      arg_min(lon, i) AS entry_lon, arg_min(lat, i) AS entry_lat FROM p GROUP BY track)"""


def features(s, d):
    # One small row per track, read several times by whatever compares tracks.
    return settle(paths.track_features(
        clipped(s, d), track="track", time="ts", order_by="ts,event_id", place="place"
    ))


@C.add("track_features", f"WITH {CLIP}, {FEATURES} SELECT track, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in paths.FEATURES) + " FROM f")
def _(s, d):
    return features(s, d).select("track", *[F.round(c, 6).alias(c) for c in paths.FEATURES])


_STD = "list_value(" + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END" for c in paths.FEATURES
) + ")"


@C.add("feature_neighbours", f"""WITH {CLIP}, {FEATURES}, z AS (SELECT track AS id, {_STD} AS e FROM f)
       SELECT query_id, item_id, rank, round(distance, 6) AS distance FROM ({_knn_sql("SELECT * FROM z", 5)})""")
def _(s, d):
    scaled = neighbours.standardise(features(s, d), columns=paths.FEATURES)
    out = neighbours.nearest(scaled, scaled, key="track", vector="vector", k=5)
    return out.select("query_id", "item_id", "rank", F.round("distance", 6).alias("distance"))


def _flat(s, d):
    x, y = paths.plane(F.col("lat"), F.col("lon"))
    return clipped(s, d).withColumns({"x": x, "y": y})


_SEG = """sqrt(pow(p.x - (s.x + t * (s.nx - s.x)), 2) + pow(p.y - (s.y + t * (s.ny - s.y)), 2))"""


@C.add("path_distance", f"""WITH {CLIP}, s AS (SELECT track, i, x, y, coalesce(lead(x) OVER w, x) AS nx, coalesce(lead(y) OVER w, y) AS ny
         FROM c WINDOW w AS (PARTITION BY track ORDER BY i)),
       j AS (SELECT p.track AS a, p.i, s.track AS b, p.x px, p.y py, s.x, s.y, s.nx, s.ny, pow(s.nx - s.x, 2) + pow(s.ny - s.y, 2) AS l
         FROM s p JOIN s ON p.track <> s.track),
       t AS (SELECT a, b, i, px, py, x, y, nx, ny, CASE WHEN l > 1e-12 THEN greatest(0, least(1, ((px - x) * (nx - x) + (py - y) * (ny - y)) / l)) ELSE 0 END AS t FROM j),
       m AS (SELECT a, b, i, min(sqrt(pow(px - (x + t * (nx - x)), 2) + pow(py - (y + t * (ny - y)), 2))) AS least FROM t GROUP BY ALL),
       h AS (SELECT a, b, avg(least) AS one FROM m GROUP BY ALL),
       d AS (SELECT h.a AS query_id, h.b AS item_id, round(0.5 * (h.one + g.one), 9) AS distance FROM h JOIN h g ON h.a = g.b AND h.b = g.a)
       SELECT query_id, item_id, round(distance, 5) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) - 1 AS rank,
         round(exp(-distance / 150.0), 6) AS score FROM d QUALIFY rank < 5""")
def _(s, d):
    flat = _flat(s, d)
    out = paths.path_distance(flat, flat, track="track", order_by="ts,event_id", k=5)
    return out.select("query_id", "item_id", F.round("distance", 5).alias("distance"), "rank",
                      F.round("score", 6).alias("score"))


def _candidates(s, d, k):
    scaled = settle(neighbours.standardise(features(s, d), columns=paths.FEATURES))
    return scaled, settle(neighbours.nearest(scaled, scaled, key="track", vector="vector", k=k))


@C.add("warped_distance")
def _(s, d):
    _scaled, pool = _candidates(s, d, 10)
    lines = settle(paths.warp_points(clipped(s, d)))
    return paths.warped_distance(pool, lines, track="track", order_by="ts,event_id")


@C.add("combined_fusion")
def _(s, d):
    scaled, pool = _candidates(s, d, 50)
    lines = settle(paths.warp_points(clipped(s, d)))
    warped = paths.warped_distance(pool, lines, track="track", order_by="ts,event_id")
    classed = settle(_classified(s, d).select("track", "track_class"))
    rule = neighbours.rule_ranks(classed, classed, key="track", label="track_class", k=50)
    return neighbours.combined_fusion(pool, warped, rule, items=scaled.count(), k=5)


CROSS = f"""q AS (SELECT *, {_R} AS r, row_number() OVER (PARTITION BY track ORDER BY ts, event_id) AS i FROM {POINTS}),
    n AS (SELECT *, lat - lag(lat) OVER w AS dlat, (lon - lag(lon) OVER w) * cos(radians(lag(lat) OVER w)) AS dlon,
      first_value(i) OVER (PARTITION BY track ORDER BY r, i) AS ci, max(i) OVER (PARTITION BY track) AS m FROM q WINDOW w AS (PARTITION BY track ORDER BY i)),
    e AS (SELECT *, CASE WHEN ci - greatest(1, ci - 8) < 2 THEN greatest(1, ci - 3) ELSE greatest(1, ci - 8) END AS a,
      CASE WHEN ci - greatest(1, ci - 8) < 2 THEN least(m, ci + 3) ELSE ci END AS b FROM n),
    x AS (SELECT track, min(r) AS d, arg_min(lat, (r, i)) AS lat, arg_min(lon, (r, i)) AS lon, CAST(count_if(r < 500) AS BIGINT) AS ctx,
      arg_min(lat, i) FILTER (r < 500) AS in_lat, arg_min(lon, i) FILTER (r < 500) AS in_lon, arg_max(lat, i) FILTER (r < 500) AS out_lat,
      arg_max(lon, i) FILTER (r < 500) AS out_lon, avg(CASE WHEN lon > 121.3 THEN 1.0 ELSE 0.0 END) FILTER (r < 500) AS east,
      coalesce(degrees(atan2(avg(dlat) FILTER (i > a AND i <= b), avg(dlon) FILTER (i > a AND i <= b))), 0) AS approach,
      coalesce(bool_or(i >= ci - 3 AND r < 400 AND lon < 120.3), false) AS west, max(place) AS place FROM e GROUP BY track),
    y AS (SELECT *, degrees(atan2(out_lat - in_lat, (out_lon - in_lon) * cos(radians(in_lat)))) AS head,
      CASE WHEN contains(place, '宜蘭') THEN 'east_north' WHEN contains(place, '花蓮') THEN 'east_central' WHEN contains(place, '臺東') THEN 'east_south'
      WHEN contains(place, '恆春') THEN 'south_tip' WHEN contains(place, '高雄') THEN 'west_south' END AS zone,
      greatest(0.4, least(0.95, 1 - d / 500)) AS sure FROM x)"""


def _crossing(s, d):
    return classes.crossing_features(
        points(s, d), track="track", order_by="ts,event_id", place="place"
    )


def _classified(s, d):
    return classes.classify(_crossing(s, d))


@C.add("crossing_features", f"""WITH {CROSS} SELECT track, round(d, 6) AS min_distance_km, lat AS closest_lat, lon AS closest_lon,
       ctx AS context_points, in_lat AS entry_lat, out_lat AS exit_lat, out_lon AS exit_lon, round(head, 6) AS context_heading,
       round(approach, 6) AS approach_heading, west AS crossed_to_west, round(east, 6) AS east_ratio, place FROM y""")
def _(s, d):
    return _crossing(s, d).withColumns({
        c: F.round(c, 6)
        for c in ("min_distance_km", "context_heading", "approach_heading", "east_ratio")
    })


@C.add("classify_tracks", f"""WITH {CROSS}, z AS (SELECT track, zone, sure, CASE
         WHEN ctx < 2 AND lat > 23.5 THEN '1a' WHEN ctx < 2 THEN '5a'
         WHEN NOT west AND lon > 120.8 AND head > 50 AND head < 125 AND lat < 26 AND east > 0.3 AND NOT (approach > 145 AND d < 60)
           AND NOT (coalesce(zone = 'east_north', false) AND d < 80) AND NOT (coalesce(zone = 'east_central', false) AND d < 50 AND approach > 120)
           AND NOT (lat > 25 AND d > 200) THEN '6'
         WHEN in_lat < 22.5 AND head < 80 AND NOT west AND lon > 120.5 AND lat < 24 AND d > 60 THEN '8'
         WHEN zone = 'east_north' THEN '2' WHEN zone = 'east_central' THEN '3' WHEN zone = 'east_south' THEN '4'
         WHEN zone = 'west_south' AND in_lat < 22.5 AND head > 60 AND out_lat > in_lat + 2.5 THEN '7' WHEN zone = 'west_south' THEN '9c'
         WHEN zone = 'south_tip' AND in_lat < 22.5 AND head > 60 AND out_lat > in_lat + 3 THEN '7' WHEN zone = 'south_tip' THEN '4b'
         WHEN in_lat < 22 AND lon < 121 AND head > 70 AND head < 140 AND out_lat > in_lat + 3 THEN '7'
         WHEN d > 100 AND lat > 23.5 THEN '1' WHEN d > 100 THEN '5' WHEN lat >= 24 THEN '2c' WHEN lat <= 22.5 THEN '4c' ELSE '3c' END AS k FROM y)
       SELECT track, k[1] AS track_class, zone AS landfall_zone, round(CASE k[2] WHEN 'a' THEN 0.4 WHEN 'b' THEN sure * 0.8 WHEN 'c' THEN sure * 0.7 ELSE sure END, 6) AS confidence FROM z""")
def _(s, d):
    return _classified(s, d).select("track", "track_class", "landfall_zone",
                                    F.round("confidence", 6).alias("confidence"))


@C.add("rule_similarity", f"""WITH v AS (SELECT vec_id AS id, embedding AS e, label, embedding[1] * 100 AS w FROM embeddings),
       j AS (SELECT a.id AS q, b.id AS i, {_D} AS dist, a.label <> b.label AS other, abs(CAST(a.w AS DOUBLE) - CAST(b.w AS DOUBLE)) AS gap FROM v a JOIN v b ON a.id <> b.id),
       t AS (SELECT q, i, 0.4 * dist / (max(dist) OVER (PARTITION BY q) + 1e-8) + CASE WHEN other THEN 0.5 ELSE 0 END + 0.1 * least(gap / 100.0, 1) AS distance FROM j)
       SELECT q AS query_id, i AS item_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY q ORDER BY distance, i) - 1 AS rank FROM t QUALIFY rank < 5""")
def _(s, d):
    e = table(s, d, "embeddings").withColumn("w", F.col("embedding")[0] * F.lit(100).cast("float"))
    out = classes.rule_similarity(e, e, key="vec_id", vector="embedding", label="label", wind="w", k=5)
    return out.select("query_id", "item_id", F.round("distance", 6).alias("distance"), "rank")


@C.add("arc_points", f"""WITH q AS (SELECT track, lat, lon, wind, row_number() OVER (PARTITION BY track ORDER BY ts, event_id) AS i FROM {POINTS}),
       g AS (SELECT *, lead(lat) OVER w AS la, lead(lon) OVER w AS lo, lead(wind) OVER w AS wi FROM q WINDOW w AS (PARTITION BY track ORDER BY i)),
       l AS (SELECT *, coalesce({hav_sql('lat', 'lon', 'la', 'lo')}, 0) AS len FROM g),
       c AS (SELECT *, sum(len) OVER (PARTITION BY track ORDER BY i) - len AS f, sum(len) OVER (PARTITION BY track ORDER BY i) AS t,
         sum(len) OVER (PARTITION BY track) / 49 AS d, la IS NULL AS final FROM l),
       k AS (SELECT *, s AS step FROM c, range(50) r(s) WHERE CASE WHEN d = 0 THEN final WHEN s = 49 THEN final ELSE s >= round(f / d, 9) AND s < round(t / d, 9) END)
       SELECT track, step, round(lat + CASE WHEN len > 0 THEN (la - lat) * (step * d - f) / len ELSE 0 END, 5) AS lat,
         round(lon + CASE WHEN len > 0 THEN (lo - lon) * (step * d - f) / len ELSE 0 END, 5) AS lon,
         round(wind + CASE WHEN len > 0 THEN (wi - wind) * (step * d - f) / len ELSE 0 END, 4) AS wind_kt FROM k""")
def _(s, d):
    out = arc_points(points(s, d), track="track", order_by="ts,event_id", points=50, values="wind_kt")
    return out.select("track", "step", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"),
                      F.round("wind_kt", 4).alias("wind_kt"))


# ---------------------------------------------------------------- rain
def _rain_text(s, d):
    return table(s, d, "embeddings").select(
        "vec_id",
        F.when(F.col("label") == 0, F.lit("---")).otherwise(
            F.concat(F.lit("約 "), F.pmod(F.col("vec_id") * 13, F.lit(500)).cast("string"), F.lit(".5 mm"))
        ).alias("tn"),
        F.pmod(F.col("vec_id") * 7, F.lit(300)).cast("string").alias("kh"),
    )


_RAIN = """(SELECT vec_id, CASE WHEN label <> 0 THEN (vec_id * 13) % 500 + 0.5 END AS tn, CAST((vec_id * 7) % 300 AS DOUBLE) AS kh FROM embeddings)"""


@C.add("event_rain", f"SELECT vec_id, CAST(tn AS DOUBLE) AS tn, kh FROM {_RAIN}")
def _(s, d):
    r = _rain_text(s, d)
    return r.select("vec_id", *[rainfall.event_rain(F.col(c)).alias(c) for c in ("tn", "kh")])


@C.add("analog_rain", f"""WITH k AS ({_knn_sql(EMB, 5)}), l AS (SELECT query_id, 'tn' AS region, CAST(tn AS DOUBLE) AS rain FROM k JOIN {_RAIN} ON item_id = vec_id
         UNION ALL SELECT query_id, 'kh', kh FROM k JOIN {_RAIN} ON item_id = vec_id)
       SELECT query_id, region, round(avg(rain) + 1e-9, 1) AS mean, round(median(rain) + 1e-9, 1) AS median, min(rain) AS min, max(rain) AS max, count(*) AS count
       FROM l WHERE rain IS NOT NULL GROUP BY ALL""")
def _(s, d):
    e = embeddings(s, d)
    near = neighbours.nearest(e, e, key="vec_id", vector="embedding", k=5)
    return rainfall.analog_rain(near, _rain_text(s, d), key="vec_id", regions="tn,kh")


@C.add("conditioned_rain", f"""WITH p AS ({PLACES}), q AS (SELECT c_custkey AS step, lat, lon, CAST(c_custkey % 90 AS DOUBLE) AS wind FROM p),
       m AS (SELECT s_suppkey AS moment_id, (s_acctbal - 120.0 * floor(s_acctbal / 120.0)) - 60 AS la, CAST((s_suppkey * 53) % 360 - 180 AS DOUBLE) AS lo,
         CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 80 AS DOUBLE) END AS w FROM supplier),
       f AS (SELECT l_suppkey AS moment_id, l_linenumber AS cell_id, avg(l_quantity) AS rain FROM lineitem GROUP BY ALL),
       j AS (SELECT *, {hav_sql('lat', 'lon', 'la', 'lo')} AS dist FROM q, m WHERE {hav_sql('lat', 'lon', 'la', 'lo')} <= 900),
       k AS (SELECT step, cell_id, rain, exp(-0.5 * pow(dist / 300, 2)) * coalesce(exp(-0.5 * pow((w - wind) / 25, 2)), 1) AS wt FROM j JOIN f USING (moment_id))
       SELECT step, cell_id, count(*) AS samples, round(sum(rain * wt) / sum(wt), 6) AS expected,
         round(sum(CASE WHEN rain >= 25 THEN wt ELSE 0 END) / sum(wt), 6) AS prob_25 FROM k GROUP BY ALL""")
def _(s, d):
    steps = places(s, d).select(
        F.col("c_custkey").alias("step"), "lat", "lon",
        F.pmod(F.col("c_custkey"), F.lit(90)).cast("double").alias("wind_kt"),
    )
    moments = table(s, d, "supplier").select(
        F.col("s_suppkey").alias("moment_id"),
        (F.pmod(F.col("s_acctbal"), F.lit(120.0)) - 60).alias("storm_lat"),
        (F.pmod(F.col("s_suppkey") * 53, F.lit(360)) - 180).cast("double").alias("storm_lon"),
        F.when(F.col("s_suppkey") % 4 > 0, (F.col("s_suppkey") % 80).cast("double")).alias("storm_wind"),
    )
    fields = table(s, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("moment_id"), F.col("l_linenumber").alias("cell_id")
    ).agg(F.avg("l_quantity").alias("rain_mm_h"))
    out = rainfall.conditioned_rain(steps, moments, fields, step="step", thresholds=[25], bandwidth_km=300)
    return out.select("step", "cell_id", "samples", F.round("expected", 6).alias("expected"),
                      F.round("prob_25", 6).alias("prob_25"))


@C.add("climatology", """SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS genesis_month, CAST(dayofyear(o_orderdate) AS BIGINT) AS genesis_dayofyear,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(48 AS DOUBLE) END AS lifetime_hours, true AS made_landfall,
       CASE WHEN w < 17.2 THEN '熱帶性低氣壓' WHEN w < 32.7 THEN '輕度颱風' WHEN w < 51 THEN '中度颱風' ELSE '強烈颱風' END AS intensity_band,
       CASE WHEN r < 80 THEN '未達大雨' WHEN r < 200 THEN '大雨' WHEN r < 350 THEN '豪雨' WHEN r < 500 THEN '大豪雨' ELSE '超大豪雨' END AS rain_band,
       CAST(w AS DOUBLE) AS wind_ms, CASE WHEN o_orderstatus <> 'P' THEN CAST(48 AS DOUBLE) END AS sea_warning_hours,
       CASE WHEN year(o_orderdate) < 2000 THEN '1990s' ELSE '2000s' END AS decade,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1 北部海面西行' WHEN '2' THEN '2 通過北部' WHEN '3' THEN '3 通過中部'
         WHEN '4' THEN '4 通過南部' ELSE '5 南部海面西行' END AS track_category
       FROM (SELECT *, o_custkey % 60 AS w, o_totalprice / 1000 - 0.0 AS r FROM orders)""")
def _(s, d):
    o = table(s, d, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderpriority",
        F.concat((F.col("o_custkey") % 60).cast("string"), F.lit(" (公尺/秒)")).alias("wind_text"),
        (F.col("o_totalprice") / 1000).cast("string").alias("rain"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("ended"),
        F.substring("o_orderpriority", 1, 1).alias("class"),
    )
    steps = climatology.climatology_steps(
        numbers=["rain"], integers=["year"], wind_text="wind_text", start="o_orderdate", end="ended",
        warned="o_orderdate", lifted="ended", place="o_orderpriority", rain="rain", year="year",
        track_class="class", drop=["wind_text", "rain", "year", "class", "ended", "o_orderpriority"],
    )
    return run_plan(steps, o)["trim"].drop("o_orderdate")
