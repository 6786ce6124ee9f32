"""Joins: equi joins with narrowing and suffixes, as-of, interval, look-ahead, distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fathomline.functions import values as V
from fathomline.functions.geo import EARTH_KM, half_chord_squared
from fathomline.operators.ordered import lay_out, over_rows
from fathomline.session import has_hot_group

HOWS = ("inner", "left", "full")
# Side of a grid cell in cutoffs, and the queries of a cell that one task takes, as many as keep all tasks busy.
_CELL, _LEAST, _MOST = 2.0, 5_000, 50_000


def join(
    left: DataFrame,
    right: DataFrame,
    *,
    on,
    how: str = "inner",
    columns=None,
    suffix: str = "_right",
) -> DataFrame:
    """Equi join. Null keys never match; clashing right columns get the suffix.

    The strategy is left to Catalyst: a side under the broadcast threshold is
    broadcast, otherwise adaptive execution splits a hot key's partition. A full
    join cannot be split that way, so it runs as a left join plus the right rows
    without a partner.
    """
    keys, wanted = V.names(on), V.names(columns)
    V.one_of("join type", how, HOWS)
    if not keys:
        raise ValueError("a join needs at least one key column")
    for side, df, cols in (("left", left, keys), ("right", right, [*keys, *wanted])):
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"the {side} table has no {missing}; it has {sorted(df.columns)}")
    if wanted:
        right = right.select(*[V.col(right, c) for c in dict.fromkeys([*keys, *wanted])])
    left, right = _aligned(left, right, keys)
    clashes = [c for c in right.columns if c in left.columns and c not in keys]
    right = right.withColumnsRenamed({c: f"{c}{suffix}" for c in clashes})
    if how != "full":
        return left.join(right, keys, how)
    alone = right.join(left.select(*keys), keys, "left_anti")
    return left.join(right, keys, "left").unionByName(alone, allowMissingColumns=True)


def _aligned(left: DataFrame, right: DataFrame, keys: list[str]):
    for key in keys:
        a, b = V.kind(left, key), V.kind(right, key)
        if a == b:
            continue
        target = (
            "bigint"
            if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)
            else "string"
        )
        left = left.withColumn(key, V.col(left, key).cast(target))
        right = right.withColumn(key, V.col(right, key).cast(target))
    return left, right


def join_metrics(left: DataFrame, right: DataFrame, *, on, how: str = "inner") -> DataFrame:
    """One row: sizes, and the left rows that found no partner."""
    keys = V.names(on)
    a, b = _aligned(left.select(*keys), right.select(*keys), keys)
    # Key counts carry all that is needed, so no joined row is ever built.
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    known = V.every([F.col(k).isNotNull() for k in keys])
    both = ca.where(known).join(cb.where(known), keys, "full")
    lost = ca.where(~known).agg(F.sum("_a").alias("n"))
    lost_right = cb.where(~known).agg(F.sum("_b").alias("n"))
    nulls_a = F.coalesce(lost.scalar(), F.lit(0))
    nulls_b = F.coalesce(lost_right.scalar(), F.lit(0))
    matched = F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0))
    alone_a = F.coalesce(F.sum(F.when(F.col("_b").isNull(), F.col("_a"))), F.lit(0)) + nulls_a
    alone_b = F.coalesce(F.sum(F.when(F.col("_a").isNull(), F.col("_b"))), F.lit(0)) + nulls_b
    out = matched
    if how in ("left", "full"):
        out = out + alone_a
    if how == "full":
        out = out + alone_b
    return both.agg(
        (F.coalesce(F.sum("_a"), F.lit(0)) + nulls_a).alias("rows_left"),
        (F.coalesce(F.sum("_b"), F.lit(0)) + nulls_b).alias("rows_right"),
        out.alias("rows_out"),
        alone_a.alias("unmatched_left"),
    )


def as_of(
    df: DataFrame, *, keys, time: str, moments: list, output: str = "as_of", tie_break=None,
    blocks: bool | None = None,
) -> DataFrame:
    """For each moment, the latest row per key at or before it.

    A row is the state from its own time until the next row of its key, so each
    row is handed the moments in that span and no key is scanned per moment. Of the
    rows between two moments only the last can be asked for; the others are cut
    inside the map task, which leaves at most a row per key and moment.
    """
    groups = V.names(keys)
    order = [time, *V.names(tie_break)]
    at = F.array(*[F.lit(m).cast("timestamp") for m in moments])
    if not blocks:
        V.need(df, *groups, *[o.lstrip("-") for o in order])
        told = F.array_min(F.filter(at, lambda m: m >= V.moment(df, time)))
        by = [F.col(f"`{g}`") for g in groups]
        # The order read backwards, nulls first where it has them last.
        turned = [
            F.col(f"`{o[1:]}`").asc_nulls_first() if o.startswith("-") else F.col(f"`{o}`").desc_nulls_first()
            for o in order
        ]
        last = Window.partitionBy(*by, "_told").orderBy(*turned)
        df = (
            df.withColumn("_told", told).where(F.col("_told").isNotNull())
            .withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_told", "_place")
        )
        blocks = False
    spanned = over_rows(
        df,
        lambda w: {"_until": F.lead(V.moment(df, time)).over(w)},
        group_by=groups,
        order_by=order,
        after=1,
        blocks=blocks,
    )
    start = V.moment(df, time)
    mine = F.filter(
        at, lambda m: (m >= start) & (F.col("_until").isNull() | (m < F.col("_until")))
    )
    return spanned.withColumn(output, F.explode(mine)).drop("_until")


def as_of_one(df: DataFrame, *, keys, time: str, moment, tie_break=None) -> DataFrame:
    """The latest row per key at or before one moment: a filter and a top-1."""
    from fathomline.operators.rows import latest_per_key

    until = F.lit(moment).cast(V.kind(df, time))
    return latest_per_key(
        df.where(V.col(df, time) <= until), keys=keys, order_by=[time, *V.names(tie_break)]
    )


def within_intervals(
    df: DataFrame,
    intervals: DataFrame,
    *,
    keys,
    time: str,
    start: str,
    end: str,
    output: str | None = None,
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Rows whose moment lies in [start, end) of an interval with their keys.

    Both sides meet on (keys, time bucket), so a busy key is spread over its
    buckets. An interval without an end runs to the last moment of the rows. With
    `output` every row is kept and flagged instead.
    """
    groups = V.names(keys)
    at = F.unix_micros(V.moment(df, time))
    width = F.lit(bucket_seconds * 1_000_000)
    last = df.agg(F.max(at)).scalar()
    begin = F.unix_micros(V.moment(intervals, start))
    finish = F.coalesce(F.unix_micros(V.moment(intervals, end)), last + 1)
    spans = (
        intervals.select(
            *[V.col(intervals, k).alias(f"_k{i}") for i, k in enumerate(groups)],
            begin.alias("_from"),
            F.least(finish, last + 1).alias("_to"),
        )
        .where(F.col("_from") < F.col("_to"))
        .withColumn(
            "_slot",
            F.explode(
                F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))
            ),
        )
        .distinct()
    )
    rows = df.withColumn("_at", at).withColumn("_in", F.floor(F.col("_at") / width))
    meet = V.every(
        [F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(groups)]
        + [
            F.col("_in") == F.col("_slot"),
            F.col("_at") >= F.col("_from"),
            F.col("_at") < F.col("_to"),
        ]
    )
    kept = rows.join(spans, meet, "left_semi")
    if not output:
        return kept.drop("_at", "_in")
    rest = rows.join(spans, meet, "left_anti")
    return (
        kept.withColumn(output, F.lit(True))
        .unionByName(rest.withColumn(output, F.lit(False)))
        .drop("_at", "_in")
    )


def look_ahead(
    df: DataFrame,
    events: DataFrame,
    *,
    keys,
    time: str,
    event_time: str,
    horizon_seconds: int,
    output: str = "lead_seconds",
    blocks: bool | None = None,
) -> DataFrame:
    """Seconds to the nearest event of the same keys in (t, t + horizon], else null.

    Rows and events are merged in time order inside (keys, horizon-wide bucket); an event also visits the
    bucket before its own. No row is paired with more than its next event. Where a bucket of some key is too
    large for a task, rows and events are laid out by (keys, time) instead, and the first event of each block
    is carried to the blocks before it. A row without a moment gets null; null keys are equal.
    """
    groups = V.names(keys)
    marks = [f"_k{i}" for i in range(len(groups))]
    step = horizon_seconds * 1_000_000
    width = F.lit(step)
    rows = df.select(F.struct("*").alias("_r"), F.unix_micros(V.moment(df, time)).alias("_t"),
                     *[V.col(df, k).alias(f"_k{i}") for i, k in enumerate(groups)])
    rows = rows.withColumn("_slot", F.floor(F.col("_t") / width)).withColumn(
        "_event", F.lit(None).cast("bigint")
    )
    at = F.unix_micros(V.moment(events, event_time))
    heads = (
        events.select(
            F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"),
            at.alias("_t"),
            *[V.col(events, k).alias(f"_k{i}") for i, k in enumerate(groups)],
        )
        .where(F.col("_t").isNotNull())
        .dropDuplicates(["_t", *marks])
        .withColumn("_event", F.col("_t"))
    )
    if has_hot_group(rows, ["_slot", *marks]) if blocks is None else blocks:
        merged = _next_event(rows.drop("_slot").unionByName(heads), marks)
    else:
        slots = F.array(F.floor(F.col("_t") / width), F.floor(F.col("_t") / width) - 1)
        later = (
            Window.partitionBy("_slot", *marks)
            .orderBy(F.col("_t").desc())
            .rangeBetween(Window.unboundedPreceding, -1)
        )
        merged = rows.unionByName(heads.withColumn("_slot", F.explode(slots))).withColumn(
            "_next", F.last("_event", ignorenulls=True).over(later)
        )
    lead = F.col("_next") - F.col("_t")
    return merged.where(F.col("_r").isNotNull()).select(
        "_r.*", F.when(lead <= width, lead / F.lit(1e6)).alias(output)
    )


def _next_event(merged: DataFrame, marks: list[str]) -> DataFrame:
    """Rows and events, latest first, with the last event before each; at one moment rows come first."""
    laid = lay_out(merged.withColumn("_is", F.col("_event").isNotNull()), marks, ["-_t", "_is"]).rows
    named = [F.col(m).alias(f"{m}b") for m in marks]
    # One row per block and key it touches; the latest of the blocks before is carried on.
    told = laid.groupBy(F.col("_block").alias("_b"), *named).agg(
        F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col("_idx"))).alias("_told")
    )
    before = Window.partitionBy(*[f"{m}b" for m in marks]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = told.withColumn("_carried", F.last("_told", ignorenulls=True).over(before)).drop("_told")
    same = [F.col("_block") == F.col("_b")] + [F.col(m).eqNullSafe(F.col(f"{m}b")) for m in marks]
    inside = Window.partitionBy("_block", *marks).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    return (
        laid.withColumn("_near", F.last("_event", ignorenulls=True).over(inside))
        .join(carried, V.every(same))
        .withColumn("_next", F.coalesce("_near", "_carried"))
    )


def within_distance(
    queries: DataFrame,
    history: DataFrame,
    *,
    cutoff_km: float,
    lat: str = "lat",
    lon: str = "lon",
    history_lat: str = "lat",
    history_lon: str = "lon",
    output: str = "distance_km",
) -> DataFrame:
    """Pairs within a great-circle cutoff, met on grid cells twice as wide as it.

    A query is in one cell; a row of the history is copied to the cells its cutoff reaches, two by two on the average.
    Only these rows are shuffled, never a pair, and all pairs of a query are made one after the other in one task. Many
    queries of one cell are dealt over parts, each with a copy of the cell's history. A product of unit vectors tells
    most pairs before any distance is worked out. Clashing history columns get `_h`.
    """
    angle = cutoff_km / EARTH_KM
    # Degrees a row reaches to the north and south; a little more than the cutoff.
    reach = math.degrees(angle) * 1.0001 + 1e-9
    tall = _CELL * reach

    def row_of(c: Column) -> Column:
        return F.floor((c + 90) / F.lit(tall))

    def sideways(row: Column) -> Column:
        # Degrees it reaches to the east and west of a query in that row of cells.
        far = F.greatest(F.abs(row * F.lit(tall) - 90), F.abs((row + 1) * F.lit(tall) - 90))
        narrow = F.when(far < 89, F.cos(F.radians(far))).otherwise(F.lit(1e-9))
        chord = F.lit(math.sin(min(angle, math.pi / 2)) * 1.0001) / narrow
        return F.when(chord < 1, F.degrees(F.asin(chord)) + 1e-9).otherwise(F.lit(360.0))

    def columns_in(row: Column) -> Column:
        # Whole columns around the globe.
        return F.greatest(F.lit(1), F.floor(F.lit(360.0 / _CELL) / sideways(row)))

    def column_of(turned: Column, count: Column) -> Column:
        return F.floor(turned / (F.lit(360.0) / count))

    def upright(df: DataFrame, own: str, la: str, lo: str) -> DataFrame:
        a, b = F.radians(F.col(la)), F.radians(F.col(lo))
        return df.withColumns({
            f"_{own}x": F.cos(a) * F.cos(b), f"_{own}y": F.cos(a) * F.sin(b), f"_{own}z": F.sin(a), f"_{own}c": F.cos(a),
        })

    cell = ["_row", "_col"]
    q = queries.withColumn("_row", row_of(F.col(lat))).withColumn("_n", columns_in(F.col("_row")))
    turned = F.pmod(F.col(lon) + 180, F.lit(360.0))
    q = q.withColumn("_col", F.least(column_of(turned, F.col("_n")), F.col("_n") - 1)).drop("_n")

    clashes = {c: f"{c}_h" for c in history.columns if c in queries.columns}
    up, turned = F.col(history_lat), F.pmod(F.col(history_lon) + 180, F.lit(360.0))
    h = history.withColumn("_row", F.explode(F.sequence(row_of(up - F.lit(reach)), row_of(up + F.lit(reach)))))
    h = h.withColumn("_n", columns_in(F.col("_row"))).withColumn("_side", sideways(F.col("_row")))
    span = F.sequence(column_of(turned - F.col("_side"), F.col("_n")), column_of(turned + F.col("_side"), F.col("_n")))
    around = F.array_distinct(F.transform(span, lambda c: F.pmod(c, F.col("_n"))))
    h = h.withColumn("_col", F.explode(F.when(F.col("_n") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(around))).drop("_n", "_side")
    h = h.withColumnsRenamed(clashes)

    tasks = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(4 * tasks, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = queries.agg(F.count(F.lit(1))).scalar()
    room = F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), F.ceil(whole / F.lit(8 * tasks))))
    # At most a row for as many queries as a part holds.
    crowded = q.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / room).alias("_parts")).where("_parts > 1")
    crowded = F.broadcast(crowded.where("_row is not null and _col is not null"))
    plain = [f.name for f in queries.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.coalesce("_parts", F.lit(1)))
    q = q.join(crowded, cell, "left").withColumn("_part", salt).drop("_parts")
    h = h.join(crowded, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    # Unit vectors are worked out after the shuffle, so that they are not written.
    met = [*cell, "_part"]
    q = upright(q.repartition(blocks, *met), "q", lat, lon)
    h = upright(h.repartition(blocks, *met), "h", clashes.get(history_lat, history_lat), clashes.get(history_lon, history_lon))

    along = sum(F.col(f"_q{a}") * F.col(f"_h{a}") for a in "xyz")
    edge = math.cos(min(angle, math.pi))
    chord = half_chord_squared(
        F.col(lat), F.col(lon),
        F.col(clashes.get(history_lat, history_lat)), F.col(clashes.get(history_lon, history_lon)), F.col("_qc"), F.col("_hc"),
    )
    d = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
    # A distance is compared only where the product leaves it open, or is not a number.
    near = along.between(F.lit(edge + 1e-9), F.lit(1.5)) | ((along >= F.lit(edge - 1e-9)) & (d <= cutoff_km))
    return (
        q.join(h, met).where(near).withColumn(output, d)
        .drop(*met, *[f"_{s}{a}" for s in "qh" for a in "xyzc"])
    )


def append(*tables: DataFrame) -> DataFrame:
    """Rows of several tables under one set of columns."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
