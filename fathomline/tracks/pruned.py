"""Exact k nearest items without visiting cells of items that cannot hold one.

Pivots, drawn once, cut the items into cells; cells that lie together are packed into blocks of a bounded size. A
first round compares a query with its own block only, which bounds its k-th best distance; a second one visits
the other blocks in which some cell may hold something nearer. An item is in one block only, and its copies are as many as
there are full blocks of queries that ask for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fathomline.operators.rows import top_per_group
from fathomline.session import BLOCK_BYTES, setting, settle

# Cells at most; what the driver holds of the items is one row of numbers for each.
MOST_PIVOTS = 256
# Items that share a block where there are so many.
LEAST_BLOCK = 4096
# Rows times blocks that are looked at together where rows are routed.
_VISITS = 4_000_000


@dataclass
class Cells:
    """Pivots, how far their items lie (least, most), further bounds, and the blocks each cell's items are in."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    more: dict[str, np.ndarray]
    first: np.ndarray
    parts: np.ndarray

    def blocks_of(self, wanted: np.ndarray) -> np.ndarray:
        """(rows, blocks) whether a row that wants some of the cells wants a block."""
        held = np.zeros((len(self.first), int((self.first + self.parts).max())), np.float32)
        for c, (first, parts) in enumerate(zip(self.first, self.parts)):
            held[c, first:first + parts] = 1.0
        return wanted.astype(np.float32) @ held > 0


@dataclass(frozen=True)
class Space:
    """What bounds a distance from below, from distances to pivots.

    ``lower`` takes (distances of rows to pivots, columns of the rows, cells) and gives a bound for every row and
    cell; ``uses`` names columns of the queries that it needs, ``keeps`` the SQL of what is known of a cell's items.
    """

    lower: Callable[[np.ndarray, dict[str, np.ndarray], Cells], np.ndarray]
    uses: tuple[str, ...] = ()
    keeps: tuple[str, ...] = ()


def apart(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1) - 2.0 * (rows @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def ball_bound(far: np.ndarray, rows: dict[str, np.ndarray], cells: Cells) -> np.ndarray:
    """Least Euclidean distance of a row to a cell's items: they keep to a ring, and on the pivot's side of the row's own one."""
    scale = 1.0 + np.abs(rows["_at"]).max(initial=0.0) + np.abs(cells.pivots).max(initial=0.0)
    ring = np.maximum(far - cells.high, cells.low - far) - 1e-6 * scale
    own = far.argmin(1)
    gap = apart(cells.pivots, cells.pivots)[own]
    nearest = far[np.arange(len(far)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        side = (far * far - nearest * nearest - 1e-9 * scale * scale) / (2.0 * gap)
    side[np.arange(len(far)), own] = 0.0
    return np.maximum(np.maximum(ring, np.nan_to_num(side, nan=0.0, posinf=0.0, neginf=0.0) - 1e-6 * scale), 0.0)


def box_bound(far: np.ndarray, rows: dict[str, np.ndarray], cells: Cells) -> np.ndarray:
    """Gap between a row's box and the box around all boxes of a cell."""
    gaps = []
    for a in "xy":
        low, high = (rows[f"_{a}{i}"][:, None] for i in "01")
        gaps.append(np.maximum(np.maximum(cells.more[f"_{a}0"] - high, low - cells.more[f"_{a}1"]), 0.0))
    return np.hypot(*gaps) * (1.0 - 1e-12)


BALLS = Space(ball_bound)
BOXES = Space(
    box_bound, ("_x0", "_y0", "_x1", "_y1"),
    ("min(_x0) AS _x0", "min(_y0) AS _y0", "max(_x1) AS _x1", "max(_y1) AS _y1"),
)


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which neighbours lie together: always the nearest one left."""
    left = list(range(1, len(pivots)))
    order = [0]
    while left:
        near = int(np.argmin(((pivots[left] - pivots[order[-1]]) ** 2).sum(1)))
        order.append(left.pop(near))
    return order


def _packed(order: list[int], counts: np.ndarray, room: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of every cell: neighbours share a block, a large cell has several."""
    first, parts = np.zeros(len(counts), int), np.ones(len(counts), int)
    block, held = 0, 0
    for c in order:
        if held and (held + counts[c] > room and held >= least or counts[c] > room):
            block, held = block + 1, 0
        first[c] = block
        if counts[c] > room:
            parts[c] = -(-counts[c] // room)
            block += parts[c]
        else:
            held += counts[c]
    return first, parts


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 1))


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    @F.pandas_udf("cell int, away double")
    def place(at: pd.Series) -> pd.DataFrame:
        far = apart(_stacked(at), pivots)
        own = far.argmin(1)
        return pd.DataFrame({"cell": own.astype(np.int32), "away": far[np.arange(len(far)), own]})

    placed = df.withColumn("_p", place("_at"))
    return placed.withColumns({"_cell": F.col("_p.cell"), "_away": F.col("_p.away")}).drop("_p")


def _home(df: DataFrame, cells: Cells) -> DataFrame:
    def told(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("_cell") + 1)

    return df.withColumn("_b", told(cells.first) + F.pmod(F.xxhash64("_key"), told(cells.parts)).cast("int"))


def _meet(queries: DataFrame, items: DataFrame, room: int, tasks: int, kernel: Callable, schema: str) -> DataFrame:
    """What the kernel makes of a block's items beside the queries that ask for it, a bounded number of them at a time.

    The number of tasks is given, as the rows are few and the work on them is not.
    """
    per = queries.groupBy("_b").agg(F.ceil(F.count("*") / F.lit(room)).cast("int").alias("_parts"))
    left = queries.join(per, "_b").withColumn("_part", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("_parts")).cast("int")).drop("_parts")
    right = items.join(per, "_b").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    right = right.toDF(*right.columns)
    left, right = (x.repartition(tasks, "_b", "_part") for x in (left, right))
    return left.groupBy("_b", "_part").cogroup(right.groupBy("_b", "_part")).applyInPandas(kernel, schema)


def routes(asked: DataFrame, cells: Cells, space: Space) -> DataFrame:
    """A row for every block beside its own that a query has to visit; ``_bound`` is its k-th best distance so far."""
    @F.pandas_udf("array<int>")
    def visit(at: pd.Series, bound: pd.Series, home: pd.Series, more: pd.DataFrame) -> pd.Series:
        rows = {"_at": _stacked(at), **{c: more[c].to_numpy(dtype=float) for c in more.columns if c != "_cell"}}
        low = space.lower(apart(rows["_at"], cells.pivots), rows, cells)
        limit = bound.fillna(np.inf).to_numpy()
        limit = limit + 1e-9 * np.abs(np.where(np.isfinite(limit), limit, 0.0)) + 1e-12
        blocks = int((cells.first + cells.parts).max())
        step, out = max(1, _VISITS // blocks), []
        for i in range(0, len(low), step):
            wanted = cells.blocks_of(low[i:i + step] <= limit[i:i + step, None])
            own = home.to_numpy(int)[i:i + step]
            wanted[np.arange(len(own)), own] = False
            rows, to = np.nonzero(wanted)
            out += np.split(to.astype(np.int32), np.searchsorted(rows, np.arange(1, len(own))))
        return pd.Series(out, dtype=object)

    found = asked.withColumn("_to", visit("_at", "_bound", "_b", F.struct("_cell", *space.uses)))
    return found.withColumn("_b", F.explode("_to")).drop("_to")


def pruned_top(
    queries: DataFrame, items: DataFrame, *, k: int, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str, space: Space, row_bytes: int,
) -> DataFrame:
    """(query_id, item_id, distance, rank) of the k nearest items of every query; ranks start at 0, ties go by item id.

    Both sides have ``_key``, ``_at`` (array of numbers; a row without has no neighbours) and what kernel and space need. The kernel gets
    a block's queries, with ``_bound`` (a distance that k items are known to keep, or null), and its items.
    """
    spark = items.sparkSession
    same = queries is items
    items = items.where("_at is not null")
    room = max(1, setting(spark, BLOCK_BYTES) // row_bytes)
    at_once = spark.sparkContext.defaultParallelism
    if items.isEmpty():
        return spark.createDataFrame([], f"{schema}, rank int")
    drawn = items.select("_at", F.xxhash64("_key").alias("h")).orderBy("h").limit(MOST_PIVOTS).collect()
    pivots = np.unique(np.array([r["_at"] for r in drawn], float), axis=0)
    known = settle(_placed(items, pivots))
    told = known.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_away").alias("low"), F.max("_away").alias("high"), *map(F.expr, space.keeps))
    rows = {r["_cell"]: r for r in told.collect()}
    # A pivot of which rounding leaves no item is as good as none.
    live = sorted(rows)
    names = [c for c in told.columns if c not in ("_cell", "n", "low", "high")]
    counts = np.array([rows[c]["n"] for c in live], int)
    # A block for each task that can run at once, with enough items in it to bound the k-th best and to be worth a visit.
    n = int(counts.sum())
    size = min(room, max(-(-n // at_once), 2 * k + 2, LEAST_BLOCK))
    first, parts = _packed(_chain(pivots[live]), counts, size, min(size, 2 * k + 2))
    cells = Cells(
        pivots[live], *(np.array([rows[c][x] for c in live], float) for x in ("low", "high")),
        {c: np.array([rows[i][c] for i in live], float) for c in names}, first, parts,
    )
    number = {c: i for i, c in enumerate(live)}
    if len(live) < len(pivots):
        renumbered = F.element_at(F.array(*[F.lit(number.get(c, 0)) for c in range(len(pivots))]), F.col("_cell") + 1)
        known = known.withColumn("_cell", renumbered)
    known = _home(known, cells)
    asked = known if same else _home(_placed(queries.where("_at is not null"), cells.pivots), cells)
    asked = asked if same else settle(asked)
    blocks = int((first + parts).max())
    tasks = max(at_once, 2 * blocks)
    together = min(room, max(1, -(-(n if same else asked.count()) // at_once)))
    found = _meet(asked.withColumn("_bound", F.lit(None).cast("double")), known, together, tasks, kernel, schema)
    if blocks > 1:
        near = settle(found)
        bounds = near.groupBy(F.col("query_id").alias("_key")).agg(F.when(F.count("*") >= k, F.max("distance")).alias("_bound"))
        routed = settle(routes(asked.join(bounds, "_key", "left"), cells, space))
        # About a task for each meeting of a block with a part of its queries, as these differ in length.
        meetings = blocks + routed.count() // together
        found = near.unionByName(_meet(routed, known, together, min(4096, max(tasks, meetings)), kernel, schema))
    ranked = top_per_group(found, k=k, group_by="query_id", order_by="distance,item_id", output="rank")
    return ranked.withColumn("rank", F.col("rank") - 1)
