"""Nearest items, rank fusion, analog votes and their leave-one-out check."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.functions import values as V
from fathomline.operators.aggregate import class_accuracy
from fathomline.operators.ordered import over_present, position
from fathomline.operators.rows import top_per_group
from fathomline.session import BLOCK_BYTES, setting, settle
from fathomline.tracks.pruned import BALLS, Space, pruned_top

# The damping of a rank, and the weights of the fused methods.
RANK_DAMPING = 60
PATH_WEIGHTS = {"path": 0.80, "feature": 0.20, "rain": 0.08}
COMBINED_WEIGHTS = {"feature": 0.2, "rule": 0.5, "rain": 0.15}
PATH_POOL, COMBINED_POOL = 12, 10
# Distances held at once while a batch of items meets a slice of the queries.
_CELLS = 4_000_000


def block_pairs(
    queries: DataFrame, items: DataFrame, *, query_by: list[Column], item_by: list[Column],
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, row_bytes: int,
) -> DataFrame:
    """What the kernel makes of every block of queries beside every block of items.

    Both sides are cut into blocks of a bounded size by the hash of the given columns, and each pair of
    blocks is one group on the executors. A side is copied once for each block of the other side; no pair
    of rows is ever a row, and nothing passes the driver but two row counts.
    """
    spark = items.sparkSession
    room = max(1, setting(spark, BLOCK_BYTES) // row_bytes)
    wide = max(1, math.ceil(queries.count() / room))
    # At least one pair of blocks for each task that can run at once.
    long = max(1, math.ceil(items.count() / room), math.ceil(spark.sparkContext.defaultParallelism / wide))

    def cut(df: DataFrame, by: list[Column], own: str, blocks: int, other: str, others: int) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        cut_up = df.withColumn(own, F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int")).withColumn(other, copies)
        return cut_up.toDF(*cut_up.columns)  # the two sides may be the same table

    left = cut(queries, query_by, "_qb", wide, "_ib", long)
    right = cut(items, item_by, "_ib", long, "_qb", wide)
    return left.groupBy("_qb", "_ib").cogroup(right.groupBy("_qb", "_ib")).applyInPandas(kernel, schema)


def plain_frame(columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """A frame whose texts are plain objects, which Arrow takes as one piece."""
    return pd.DataFrame({n: v if v.dtype.kind in "iufb" else pd.Series(v, dtype=object) for n, v in columns.items()})


def _stack(column: pd.Series) -> np.ndarray:
    if len(column) and isinstance(column.iloc[0], (list, np.ndarray)):
        return np.stack([np.asarray(v, dtype=float) for v in column])
    return column.to_numpy()


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def rough_squares(q: dict, items: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of every query to every item but for rounding, and how far off a query's may be."""
    a, b = q["vector"], items["vector"]
    one, other = (a * a).sum(1), (b * b).sum(1)
    rough = np.column_stack([a * -2.0, one, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), other]).T
    return rough, 1e-12 * (1.0 + one + np.nanmax(other, initial=0.0))


def exact(q: dict, items: dict, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of the given pairs, a bounded number of them at a time."""
    a, b = q["vector"], items["vector"]
    step = max(1, _CELLS // max(1, a.shape[1]))
    parts = [np.sqrt(((a[rows[i:i + step]] - b[cols[i:i + step]]) ** 2).sum(1)) for i in range(0, len(rows), step)]
    return np.concatenate(parts or [np.zeros(0)])


def kth_least(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th least number of each row, infinite where there are fewer."""
    return np.partition(values, k - 1, axis=1)[:, k - 1] if values.shape[1] > k else np.full(len(values), np.inf)


def own_edge(bound: np.ndarray, k: int, score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What the k nearest keep: the bound at hand, or the k-th least score of a query that has none."""
    free = np.flatnonzero(~np.isfinite(bound))
    edge = bound.copy()
    if len(free):
        edge[free] = kth_least(score(free), k)
    return edge


# Items of a row of distances of which the least one is looked at first.
_STRIPE = 128
# Pairs of a row that single precision may leave before it is told too coarse.
_COARSE = 64


def _single_close(q: dict, items: dict, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs that may be among the k nearest, from squared distances in single precision; None where that tells too little.

    Vectors are taken from the middle of the items. Of every stripe of items the least distance is found first: the
    k-th least of these bounds a query without a bound, and only stripes below its bound are looked through.
    """
    if "_single" not in items:
        # A vector without a number somewhere has no distance to anything.
        good = np.isfinite(items["vector"]).all(1)
        middle = items["vector"][good].mean(0) if good.any() else np.zeros(items["vector"].shape[1])
        b = np.where(good[:, None], items["vector"] - middle, 0.0)
        squares = np.where(good, (b * b).sum(1), np.inf)
        with np.errstate(over="ignore"):
            held = np.pad(np.column_stack([b, np.ones(len(b)), squares]).astype(np.float32), ((0, -len(b) % _STRIPE), (0, 0)))
        held[len(b):, -1] = np.inf
        items["_single"] = middle, held, float(squares[good].max(initial=0.0))
    middle, held, most = items["_single"]
    a = q["vector"] - middle
    one = (a * a).sum(1)
    # Twice the bound of the rounding of a sum of so many products, and of the numbers themselves.
    off = 2.0 * (a.shape[1] + 8) * 2.0 ** -23 * (one + most)
    if not np.all(off < 1e30):
        return None
    rough = np.column_stack([a * -2.0, one, np.ones(len(a))]).astype(np.float32) @ held.T
    rough[q["self"]] = np.inf
    striped = rough.reshape(len(a), -1, _STRIPE)
    least = striped.min(2)
    edge = own_edge(q["bound"] ** 2, k, lambda free: (least if least.shape[1] > k else rough)[free])
    limit = np.minimum(edge * (1 + 1e-6) + 2.0 * off, np.finfo(np.float32).max).astype(np.float32)
    rows, stripes = np.nonzero(least <= limit[:, None])
    each = max(1, _CELLS // _STRIPE)
    found = [np.zeros((2, 0), int)]
    for i in range(0, len(rows), each):
        row, stripe = rows[i:i + each], stripes[i:i + each]
        some, at = np.nonzero(striped[row, stripe] <= limit[row, None])
        found.append(np.stack([row[some], stripe[some] * _STRIPE + at]))
    close = np.concatenate(found, axis=1)
    return None if close.shape[1] > (_COARSE + 8 * k) * len(a) else (close[0], close[1])


def euclid(q: dict, items: dict, k: int) -> Found:
    """Exact distances of whatever may be among a query's k nearest."""
    close = _single_close(q, items, k)
    if close is not None:
        return *close, exact(q, items, *close)
    rough, off = rough_squares(q, items)
    rough[q["self"]] = np.inf
    edge = own_edge(q["bound"] ** 2, k, lambda free: rough[free])
    slack = 1e-9 * np.where(np.isfinite(edge), edge, 0.0) + 2 * off
    rows, cols = np.nonzero(rough <= np.minimum(edge + slack, np.finfo(float).max)[:, None])
    return rows, cols, exact(q, items, rows, cols)


def scan_top(
    queries: DataFrame,
    items: DataFrame,
    *,
    key: str,
    columns: list[str],
    kernel: Callable[[dict, dict, int], Found],
    k: int,
    at: str,
    space: Space = BALLS,
    exclude_self: bool = True,
    row_bytes: int = 1024,
) -> DataFrame:
    """(query_id, item_id, distance, rank): the k nearest items of every query, cells of items by the vector ``at``.

    ``space`` bounds the kernel's distances from below, so that a query visits only the blocks that may hold one of its
    nearest items. The kernel gets a slice of the queries, with the ``bound`` of each (infinite where none is known) and the pairs
    ``self`` to leave out, and names the pairs that may be among the k nearest: rows, columns, distances. Ranks start at 0, ties
    go by item id.
    """
    schema = (
        f"query_id {V.kind(queries, key).simpleString()}, item_id {V.kind(items, key).simpleString()}, distance double"
    )

    def rows(df: DataFrame, wanted: list[str]) -> DataFrame:
        return df.select(V.col(df, key).alias("_key"), V.col(df, at).alias("_at"), *[V.col(df, c) for c in wanted])

    known = rows(items, columns)
    asked = known if queries is items else rows(queries, [c for c in queries.columns if c != key])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("_key", kind="stable")
        ids, names = right["_key"].to_numpy(), left["_key"].to_numpy()
        it = {c: _stack(right[c]) for c in columns}
        q = {"ids": names, **{c: _stack(left[c]) for c in left.columns if not c.startswith("_")}}
        found: list[Found] = []
        limit = left["_bound"].fillna(np.inf).to_numpy(dtype=float)
        # Items are in id order, so those of one id follow each other.
        _each, starts, sizes = np.unique(pd.factorize(ids, use_na_sentinel=False)[0], return_index=True, return_counts=True)
        whose = pd.Index(ids[starts]).get_indexer(pd.Index(names)) if exclude_self and len(ids) else np.full(len(names), -1)
        step = max(1, _CELLS // max(1, len(ids)))
        for lo in range(0, len(names) if len(ids) else 0, step):
            mine = {c: v[lo:lo + step] for c, v in q.items()}
            mine["bound"] = limit[lo:lo + step]
            own = whose[lo:lo + step]
            at = np.flatnonzero(own >= 0)
            many = sizes[own[at]]
            mine["self"] = (
                np.repeat(at, many),
                np.repeat(starts[own[at]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many),
            )
            rows, cols, d = kernel(mine, it, k)
            keep = np.isfinite(d)
            rows, cols, d = rows[keep], cols[keep], d[keep]
            # The items are in id order, so ties go by id.
            order = np.lexsort((cols, d, rows))
            rows, cols, d = rows[order], cols[order], d[order]
            near = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            found.append((mine["ids"][rows[near]], ids[cols[near]], d[near]))
        if not found:
            return plain_frame({"query_id": names[:0], "item_id": ids[:0], "distance": np.zeros(0)})
        one, other, far = (np.concatenate(x) for x in zip(*found))
        return plain_frame({"query_id": one, "item_id": other, "distance": far})

    return pruned_top(asked, known, k=k, kernel=meet, schema=schema, space=space, row_bytes=row_bytes)


def nearest(
    queries: DataFrame, items: DataFrame, *, key: str, vector: str, k: int = 5,
    exclude_self: bool = True,
) -> DataFrame:
    """The k nearest items by Euclidean distance, with a score relative to the k-th."""

    def plain(df: DataFrame) -> DataFrame:
        return df.select(V.col(df, key), V.col(df, vector).cast("array<double>").alias("vector"))

    asked = settle(plain(queries))
    # One pass over the queries alone tells how wide a vector is.
    wide = asked.agg(F.max(F.size("vector"))).first()[0] or 1
    found = scan_top(
        asked, asked if queries is items else plain(items), key=key, columns=["vector"], at="vector",
        kernel=euclid, k=k, exclude_self=exclude_self, row_bytes=8 * wide + 16 * k,
    )
    farthest = F.max("distance").over(Window.partitionBy("query_id"))
    return found.withColumn("score", 1.0 - F.col("distance") / (farthest + F.lit(1e-8)))


def standardise(df: DataFrame, *, columns, weights: list[float] | None = None,
                output: str = "vector") -> DataFrame:
    """Columns centred and scaled by their population spread, as one array."""
    wanted = V.names(columns)
    parts = df.agg(
        F.struct(
            *[F.avg(V.number(df, c)).alias(f"m{i}") for i, c in enumerate(wanted)],
            *[F.stddev_pop(V.number(df, c)).alias(f"s{i}") for i, c in enumerate(wanted)],
        )
    ).scalar()
    scaled = [
        (V.number(df, c) - parts[f"m{i}"])
        / F.when(parts[f"s{i}"] > 0, parts[f"s{i}"]).otherwise(F.lit(1.0))
        * F.lit(float(weights[i]) if weights else 1.0)
        for i, c in enumerate(wanted)
    ]
    return df.withColumn(output, F.array(*scaled))


def random_analogs(queries: DataFrame, items: DataFrame, *, key: str, k: int = 5,
                   seed: int = 42) -> DataFrame:
    """The baseline: k others per query, drawn without replacement.

    Items get dense positions in the order of their hash. A query draws k + 1 distinct positions: its own hash
    is the start and an odd-stepped walk over the positions the order, so n times k rows exist in all. Items of a repeated
    key are drawn as one.
    """
    def drawn(column: str, salt: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed + salt))).cast("binary")), 1, 15), 16, 10).cast("long")

    known = settle(items.select(V.col(items, key).alias("item_id")).where("item_id is not null").distinct())
    n = known.count()
    placed = settle(position(known.withColumn("_h", drawn("item_id", 0)), "_at", group_by=[], order_by="_h,item_id"))
    asked = queries.select(V.col(queries, key).alias("query_id")).where("query_id is not null").distinct()
    steps = _coprime(max(1, n))
    step = F.element_at(F.array(*[F.lit(s).cast("long") for s in steps]), (drawn("query_id", 1) % len(steps)).cast("int") + 1)
    start = drawn("query_id", 2) % max(1, n)
    draws = asked.withColumns({"_start": start, "_step": step}).withColumn(
        "_draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(k, max(0, n - 1))).cast("long")))
    )
    at = draws.withColumn("_at", F.pmod(F.col("_start") + F.col("_draw") * F.col("_step"), F.lit(max(1, n))) + 1)
    pairs = at.join(placed.select("item_id", "_at"), "_at").where("query_id <> item_id")
    ranked = top_per_group(pairs.select("query_id", "item_id", "_draw"), k=k, group_by="query_id", order_by="_draw", output="rank")
    return ranked.select("query_id", "item_id", (F.col("rank") - 1).alias("rank"))


def _coprime(n: int) -> list[int]:
    """Sixty-four steps spread over 1..n that share no divisor with it: a walk by one visits every position before the first again."""
    found: list[int] = []
    for i in range(64):
        s = max(1, n * (2 * i + 1) // 128)
        while math.gcd(s, n) != 1:
            s += 1
        found.append(s)
    return found


def difference_ranks(
    queries: DataFrame, items: DataFrame, *, key: str, value: str, k: int
) -> DataFrame:
    """Items by how near their value is to the query's; items without one come last.

    Items and queries are laid out once by value; the k + 1 items before a query and the k + 1 behind it hold its
    nearest ones, up to ties with the farthest of them, which the items of these values add. Items without a
    value are wanted only where there are too few others, so the first k + 1 of them by id do.
    """
    def slim(df: DataFrame) -> DataFrame:
        return df.select(V.col(df, key).alias("_key"), V.number(df, value).alias("v"))

    known, asked = settle(slim(items)), slim(queries).where(F.col("v").isNotNull())
    # Of the items of one value only the first k + 1 by id can be among a query's k nearest.
    values = top_per_group(known.where(F.col("v").isNotNull()), k=k + 1, group_by="v", order_by="_key", output="_n")
    held = values.groupBy("v").agg(F.array_sort(F.collect_list("_key")).alias("keys"))
    # A value and the wanted ones; both tables meet in the order of values.
    points = asked.select("v").distinct().withColumn("asks", F.lit(True)).join(held, "v", "full").withColumn("here", F.col("keys").isNotNull())
    slot = F.when(F.col("here"), F.struct("v", "keys"))
    points = points.withColumn("slot", slot)
    near = over_present(
        points, F.col("slot"), lambda w: {"before": F.collect_list("slot").over(w)}, window=k + 1, group_by=[], order_by="v"
    )
    behind = over_present(
        near.withColumn("_down", -F.col("v")), F.col("slot"), lambda w: {"after": F.collect_list("slot").over(w)},
        window=k + 2, group_by=[], order_by="_down",
    )
    around = behind.where("asks").select("v", F.explode(F.array_distinct(F.concat("before", "after"))).alias("s"))
    listed = around.select("v", F.explode("s.keys").alias("item_id"), F.col("s.v").alias("w"))
    # A value's own list is cut to what any query of it can use, itself left out later.
    best = top_per_group(
        listed.withColumn("_d", F.abs(F.col("v") - F.col("w"))), k=k + 1, group_by="v", order_by="_d,item_id", output="_n"
    ).select("v", "item_id", "_d")
    blank = top_per_group(known.where(F.col("v").isNull()).withColumn("_all", F.lit(0)), k=k + 1, group_by="_all", order_by="_key", output="_n")
    pairs = asked.withColumnRenamed("_key", "query_id").join(best, "v").select("query_id", "item_id", "_d")
    # At most k + 1 rows.
    spare = asked.select(F.col("_key").alias("query_id")).join(F.broadcast(blank.select(F.col("_key").alias("item_id"))))
    both = pairs.unionByName(spare.withColumn("_d", F.lit(1e300))).where("query_id <> item_id")
    ranked = top_per_group(both, k=k, group_by="query_id", order_by="_d,item_id", output="rank")
    return ranked.select("query_id", "item_id", F.col("_d").alias("distance"), (F.col("rank") - 1).alias("rank"))


def fuse_ranks(
    ranked: list[tuple[DataFrame, float, int]], *, k: int = 5, damping: int = RANK_DAMPING
) -> DataFrame:
    """Reciprocal rank fusion of (ranks, weight, rank where missing).

    All rank tables are stacked and met by one aggregation on (query, item).
    """
    stacked = None
    for i, (df, _, _) in enumerate(ranked):
        one = df.select("query_id", "item_id", F.lit(i).alias("_src"), F.col("rank").alias("_rank"))
        stacked = one if stacked is None else stacked.unionByName(one)
    score = sum(
        F.lit(float(w))
        / (F.coalesce(F.min(F.when(F.col("_src") == i, F.col("_rank"))), F.lit(missing)) + damping)
        for i, (_, w, missing) in enumerate(ranked)
    )
    # Rounded so that ties do not hang on the last bit of a sum.
    fused = stacked.groupBy("query_id", "item_id").agg(F.round(score, 12).alias("fused"))
    top = top_per_group(
        fused, k=k, group_by="query_id", order_by="-fused,item_id", output="rank"
    ).withColumn("rank", F.col("rank") - 1)
    best = F.max("fused").over(Window.partitionBy("query_id"))
    scored = top.withColumn("score", F.col("fused") / (best + F.lit(1e-8)))
    return scored.withColumn("distance", 1.0 - F.col("score"))


def pool_size(items: int, k: int, factor: int) -> int:
    return min(items - 1, k * factor)


def rule_ranks(queries: DataFrame, items: DataFrame, *, key: str, label: str, k: int) -> DataFrame:
    """Items of the query's class first, the others after them, each in id order."""
    each = items.select(V.col(items, key).alias("_id"), V.col(items, label).alias("_label"))
    asked = queries.select(V.col(queries, key).alias("query_id"), V.col(queries, label).alias("_c"))
    # One more than k, since a query itself may stand among its class.
    own = top_per_group(each, k=k + 1, group_by="_label", order_by="_id", output="_order")
    # The first k + 1 by id of other classes are among the first k + 1 of all classes but one, hence among
    # the 2k + 2 first when of each class only k + 1 are listed.
    first = top_per_group(own.withColumn("_all", F.lit(0)), k=2 * k + 2, group_by="_all", order_by="_id", output="_place")
    wanted = asked.select("_c").distinct()
    # At most 2k + 2 rows meet every class.
    others = wanted.join(F.broadcast(first.select("_id", "_label"))).where(~F.col("_c").eqNullSafe(F.col("_label")))
    listed = own.select(F.col("_label").alias("_class"), "_id", F.lit(0).alias("_other")).unionByName(
        others.select(F.col("_c").alias("_class"), "_id", F.lit(1).alias("_other"))
    )
    listed = top_per_group(listed, k=k + 1, group_by="_class", order_by="_other,_id", output="_order")
    pairs = asked.join(listed, F.col("_c").eqNullSafe(F.col("_class"))).where(
        F.col("query_id") != F.col("_id")
    )
    ranked = top_per_group(
        pairs.select("query_id", F.col("_id").alias("item_id"), "_order"), k=k, group_by="query_id",
        order_by="_order", output="rank",
    )
    return ranked.select("query_id", "item_id", (F.col("rank") - 1).alias("rank"))


def vote(neighbours: DataFrame, labels: DataFrame, *, key: str, label: str) -> DataFrame:
    """The label with the most weight e^-d among a query's analogs, and its share."""
    named = labels.select(V.col(labels, key).alias("item_id"), V.col(labels, label).alias("label"))
    held = neighbours.join(named, "item_id").where(F.col("label").isNotNull())
    weights = held.groupBy("query_id", "label").agg(
        F.sum(F.exp(-F.col("distance"))).alias("weight"), F.min("rank").alias("_first")
    )
    # Equal weights go to the label of the nearer analog.
    best = F.struct(F.round("weight", 12), -F.col("_first"))
    return weights.groupBy("query_id").agg(
        F.max_by("label", best).alias("predicted"),
        (F.max("weight") / F.sum("weight")).alias("confidence"),
    )


def leave_one_out(
    predictions: DataFrame, labels: DataFrame, *, key: str, label: str
) -> tuple[DataFrame, DataFrame]:
    """Votes beside the true labels, and the accuracy they reach."""
    true = labels.select(V.col(labels, key).alias("query_id"), V.col(labels, label).alias("actual"))
    judged = true.join(predictions, "query_id").withColumn(
        "is_correct", F.col("actual") == F.col("predicted")
    )
    return judged, class_accuracy(judged, actual="actual", predicted="predicted")


def sample_queries(df: DataFrame, *, key: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """A repeatable sample of at most `limit` queries; None takes them all."""
    if limit is None:
        return df
    return df.orderBy(F.xxhash64(V.col(df, key), F.lit(seed)), V.col(df, key)).limit(limit)


def path_fusion(
    path: DataFrame, feature: DataFrame, rain: DataFrame | None = None, *, items: int, k: int = 5,
    weights: dict | None = None,
) -> DataFrame:
    """Path and feature ranks, and optionally rain ranks, as one ranking."""
    w, pool = {**PATH_WEIGHTS, **(weights or {})}, pool_size(items, k, PATH_POOL)
    parts = [(path, w["path"], pool), (feature, w["feature"], pool)]
    if rain is not None:
        parts.append((rain, w["rain"], items))
    return fuse_ranks(parts, k=k)


def combined_fusion(
    feature: DataFrame, warped: DataFrame, rule: DataFrame, rain: DataFrame | None = None, *,
    items: int, k: int = 5, weights: dict | None = None,
) -> DataFrame:
    """Feature, warped-path and rule ranks; the warped path takes what weight is left."""
    w, pool = {**COMBINED_WEIGHTS, **(weights or {})}, pool_size(items, k, COMBINED_POOL)
    left = max(0.0, 1.0 - w["feature"] - w["rule"] - (w["rain"] if rain is not None else 0.0))
    parts = [(feature, w["feature"], pool), (warped, left, pool), (rule, w["rule"], items)]
    if rain is not None:
        parts.append((rain, w["rain"], items))
    return fuse_ranks(parts, k=k)
