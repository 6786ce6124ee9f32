"""Row order without one big task.

A window over a whole table, or over a group that holds a third of it, would put
all those rows into one task. Where that threatens, rows are laid out once in
(group, order) order by a range shuffle, cut into blocks of equal row count, and
each block borrows the few rows of its neighbours that its frames can reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from fathomline.functions.values import must_order, names, need, ordering
from fathomline.session import HOT_ROWS, has_hot_group, setting, settle

# A layout never has more blocks than this, so a per-block table stays small.
MOST_BLOCKS = 50_000
_IN_PART = (1 << 33) - 1
HELPERS = ("_row", "_idx", "_block", "_home")


@dataclass
class Layout:
    """Rows with their global 0-based position and the block it falls in."""

    rows: DataFrame
    total: int
    block_rows: int

    @property
    def blocks(self) -> int:
        return max(1, math.ceil(self.total / self.block_rows))


def _tie_breaker(df: DataFrame) -> list[Column]:
    """A hash of the row, so that rows of one order value do not all fall into one range."""
    plain = [f.name for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return [F.xxhash64(*[F.col(f"`{c}`") for c in plain])] if plain else []


def _laid(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows written in order of the keys, numbered by `_row` inside each partition, and the partitions' sizes."""
    keys = keys + _tie_breaker(df)
    laid = settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_row", 33)
    # One row per partition of the layout.
    held = laid.groupBy(part.alias("p")).agg(F.max(F.col("_row").bitwiseAND(F.lit(_IN_PART))) + 1)
    return laid, sorted((r[0], r[1]) for r in held.collect())


def lay_out(df: DataFrame, group_by: list[str], order_by: list[str], reach: int = 1) -> Layout:
    spark = df.sparkSession
    laid, sizes = _laid(df, [F.col(f"`{g}`").asc_nulls_first() for g in group_by] + ordering(order_by))
    part = F.shiftrightunsigned("_row", 33)
    at = F.col("_row").bitwiseAND(F.lit(_IN_PART))
    starts, total = [], 0
    for p, size in sizes:
        starts.append((p, total))
        total += size
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    block_rows = max(reach, setting(spark, HOT_ROWS), math.ceil(total / MOST_BLOCKS), 1)
    rows = (
        laid.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_idx", F.col("_start") + at)
        .withColumn("_block", F.floor(F.col("_idx") / F.lit(block_rows)))
        .drop("_part", "_start")
    )
    return Layout(rows, total, block_rows)


def page_rows(df: DataFrame, *, offset: int, length: int, order_by) -> DataFrame:
    """Rows `offset` to `offset + length` of the order.

    Near the start the rows up to the page's end are cut in every task. A page that ends further back than one
    task may hold is found by the sizes of the ranges of a layout, and only the files that hold it are read.
    """
    order = must_order(order_by)
    need(df, *[o.lstrip("-") for o in order])
    offset, length = max(0, int(offset)), max(0, int(length))
    if offset + length <= setting(df.sparkSession, HOT_ROWS):
        return df.orderBy(*ordering(order)).offset(offset).limit(length)
    laid, sizes = _laid(df, ordering(order))

    def place(wanted: int) -> int:
        """The number of the row at a position; beyond the last row, one past every number."""
        for p, size in sizes:
            if wanted < size:
                return (p << 33) + wanted
            wanted -= size
        return (sizes[-1][0] + 1) << 33 if sizes else 0

    here = (F.col("_row") >= F.lit(place(offset))) & (F.col("_row") < F.lit(place(offset + length)))
    return laid.where(here).orderBy("_row").drop("_row")


def needs_blocks(df: DataFrame, group_by: list[str], blocks: bool | None) -> bool:
    """Ungrouped order always goes by blocks; grouped order where a group is hot."""
    if not group_by:
        return True
    return has_hot_group(df, group_by) if blocks is None else blocks


def over_rows(
    df: DataFrame,
    outputs: Callable[[WindowSpec], dict[str, Column]],
    *,
    group_by=None,
    order_by,
    before: int = 0,
    after: int = 0,
    blocks: bool | None = None,
) -> DataFrame:
    """Window columns whose frames reach at most `before` and `after` rows."""
    groups, order = names(group_by), must_order(order_by)
    need(df, *groups, *[o.lstrip("-") for o in order])
    if not needs_blocks(df, groups, blocks):
        w = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(*ordering(order))
        return df.withColumns(outputs(w))

    layout = lay_out(df, groups, order, max(before, after, 1))
    size = layout.block_rows
    within = F.col("_idx") % F.lit(size)
    home = F.col("_home")
    visits = [home]
    if before:
        visits.append(F.when(within >= size - before, home + 1))
    if after:
        visits.append(F.when(within < after, home - 1))
    placed = layout.rows.withColumnRenamed("_block", "_home").withColumn(
        "_block", F.explode(F.array_compact(F.array(*visits)))
    )
    w = Window.partitionBy("_block", *[F.col(f"`{g}`") for g in groups]).orderBy("_idx")
    return (
        placed.withColumns(outputs(w))
        .where(F.col("_block") == F.col("_home"))
        .drop(*HELPERS)
    )


def position(
    df: DataFrame, output: str, *, group_by=None, order_by, blocks: bool | None = None
) -> DataFrame:
    """1-based row number, inside each group or over the whole table."""
    groups, order = names(group_by), must_order(order_by)
    if not needs_blocks(df, groups, blocks):
        w = Window.partitionBy(*[F.col(f"`{g}`") for g in groups]).orderBy(*ordering(order))
        return df.withColumn(output, F.row_number().over(w).cast("long"))
    layout = lay_out(df, groups, order)
    if not groups:
        return layout.rows.withColumn(output, F.col("_idx") + 1).drop(*HELPERS)
    first = layout.rows.groupBy(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)]
                                ).agg(F.min("_idx").alias("_first"))
    same = [F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    return (
        layout.rows.join(first, same)
        .withColumn(output, F.col("_idx") - F.col("_first") + 1)
        .drop("_first", *HELPERS, *[f"_g{i}" for i in range(len(groups))])
    )


def over_present(
    df: DataFrame,
    value: Column,
    outputs: Callable[[WindowSpec], dict[str, Column]],
    *,
    window: int,
    group_by=None,
    order_by,
    blocks: bool | None = None,
) -> DataFrame:
    """Frames over the last `window` rows that have a value.

    Rows are numbered by how many values came up to and including them, and the
    frame is a RANGE over that number. A row without a value shares the number of
    the value before it, so it sees the same frame.
    """
    groups, order = names(group_by), must_order(order_by)
    need(df, *groups, *[o.lstrip("-") for o in order])
    keyed = df.withColumn("_v", value)
    by = [F.col(f"`{g}`") for g in groups]
    if not needs_blocks(df, groups, blocks):
        w = Window.partitionBy(*by).orderBy(*ordering(order))
        running = F.count("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))
        frame = Window.partitionBy(*by).orderBy("_k").rangeBetween(-(window - 1), 0)
        return (
            keyed.withColumn("_k", running).withColumns(outputs(frame)).drop("_v", "_k")
        )

    spark = df.sparkSession
    layout = lay_out(keyed, groups, order)
    per_block = {
        r["_block"]: r["n"]
        for r in layout.rows.groupBy("_block").agg(F.count("_v").alias("n")).collect()
    }
    # Values before each block, and the earlier blocks that hold the last `window` of them. Blocks
    # without values are never looked at, so the walk back takes at most `window` steps.
    before, seen, lends, filled = [], 0, [], []
    for block in range(layout.blocks):
        before.append(seen)
        missing = window
        for source, held in reversed(filled):
            lends.append((source, block, seen))
            missing -= held
            if missing <= 0:
                break
        if per_block.get(block, 0):
            filled.append((block, per_block[block]))
            seen += per_block[block]
    starts = spark.createDataFrame(list(enumerate(before)), "_block long, _before long")
    in_block = Window.partitionBy("_block").orderBy("_idx").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = (
        layout.rows.join(F.broadcast(starts), "_block")
        .withColumn("_k", F.col("_before") + F.count("_v").over(in_block))
        .drop("_before")
        .withColumn("_home", F.lit(True))
    )
    if lends:
        table = spark.createDataFrame(lends, "_block long, _to long, _start long")
        lent = (
            rows.where(F.col("_v").isNotNull())
            .join(F.broadcast(table), "_block")
            .where((F.col("_k") <= F.col("_start")) & (F.col("_k") > F.col("_start") - window))
            .withColumn("_block", F.col("_to"))
            .withColumn("_home", F.lit(False))
            .drop("_to", "_start")
        )
        rows = rows.unionByName(lent)
    frame = Window.partitionBy("_block", *by).orderBy("_k").rangeBetween(-(window - 1), 0)
    return rows.withColumns(outputs(frame)).where("_home").drop("_v", "_k", *HELPERS)


def running_sum(
    df: DataFrame, value: Column, output: str, *, group_by=None, order_by,
    blocks: bool | None = None,
) -> DataFrame:
    """Running total up to and including each row, restarting at every group."""
    groups, order = names(group_by), must_order(order_by)
    by = [F.col(f"`{g}`") for g in groups]
    keyed = df.withColumn("_v", F.coalesce(value, F.lit(0.0)))
    if not needs_blocks(df, groups, blocks):
        w = Window.partitionBy(*by).orderBy(*ordering(order))
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return keyed.withColumn(output, F.sum("_v").over(upto)).drop("_v")
    rows = lay_out(keyed, groups, order).rows
    keys = [F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)]
    gs = [f"_g{i}" for i in range(len(groups))]
    # One row per block and group it touches; only these are summed in sequence.
    sums = rows.groupBy(F.col("_block").alias("_b"), *keys).agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*gs).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)))
    same = F.col("_block") == F.col("_b")
    for g, k in zip(groups, gs):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(k))
    inside = Window.partitionBy("_block", *by).orderBy("_idx").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        rows.withColumn("_in", F.sum("_v").over(inside))
        .join(sums, same)
        .withColumn(output, F.col("_before") + F.col("_in"))
        .drop("_v", "_in", "_b", "_s", "_before", *gs, *HELPERS)
    )
