"""The pruned neighbour join against all pairs, and how little of the other side its queries visit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.tracks import neighbours, paths, pruned
from fathomline.tracks.classes import rule_similarity


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pruned, "LEAST_BLOCK", 20)


def clustered(spark, n=600, clusters=12, wide=3, seed=1):
    r = np.random.default_rng(seed)
    at = r.normal(size=(clusters, wide)) * 100
    rows = [(i, (at[i % clusters] + r.normal(size=wide)).tolist()) for i in range(n)]
    # Copies of one item, more than a block holds.
    rows += [(n + i, rows[0][1]) for i in range(150)]
    return spark.createDataFrame(rows, "id long, v array<double>"), rows


def all_pairs(rows, others, k):
    ids = np.array([i for i, _ in others])
    at = np.array([v for _, v in others])
    out = set()
    for i, v in rows:
        far = np.sqrt(((at - np.array(v)) ** 2).sum(1))
        far[ids == i] = np.inf
        order = np.lexsort((ids, far))[:k]
        out |= {(i, int(ids[j]), rank, round(float(far[j]), 9)) for rank, j in enumerate(order)}
    return out


def told(df):
    return {(r["query_id"], r["item_id"], r["rank"], round(r["distance"], 9)) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 5, 30])
def test_nearest(spark, small_blocks, k):
    df, rows = clustered(spark)
    assert told(neighbours.nearest(df, df, key="id", vector="v", k=k)) == all_pairs(rows, rows, k)


def test_other_queries(spark, small_blocks):
    df, rows = clustered(spark)
    asked, mine = clustered(spark, n=80, seed=9)
    assert told(neighbours.nearest(asked, df, key="id", vector="v", k=4)) == all_pairs(mine, rows, 4)
    assert neighbours.nearest(asked.limit(0), df, key="id", vector="v", k=4).count() == 0
    assert neighbours.nearest(asked, df.limit(0), key="id", vector="v", k=4).count() == 0
    missing = asked.withColumn("v", F.when(F.col("id") > 3, F.col("v")))
    assert {r["query_id"] for r in neighbours.nearest(missing, df, key="id", vector="v", k=4).collect()} == {i for i, _ in mine if i > 3}


def test_few_blocks_are_visited(spark, small_blocks, monkeypatch):
    """Every item is in one block, and clustered queries go to few of the others."""
    visits = []
    plain = pruned.routes

    def counted(asked, cells, space):
        out = plain(asked, cells, space)
        visits.append((out.count(), asked.count(), int((cells.first + cells.parts).max())))
        return out

    monkeypatch.setattr(pruned, "routes", counted)
    df, rows = clustered(spark, n=2400, clusters=40)
    neighbours.nearest(df, df, key="id", vector="v", k=3).collect()
    (made, asked, blocks), = visits
    assert blocks >= 8 and made < 0.25 * asked * (blocks - 1)


def test_rule_similarity(spark, small_blocks):
    df, rows = clustered(spark, n=200)
    rows = rows[:200]
    both = df.where("id < 200").withColumns({"c": (F.col("id") % 3).cast("string"), "w": (F.col("id") * 7 % 50).cast("double")})
    got = {(r["query_id"], r["rank"]): (r["item_id"], round(r["distance"], 9)) for r in
           rule_similarity(both, both, key="id", vector="v", label="c", wind="w", k=4).collect()}
    from fathomline.tracks.classes import WEIGHTS as w
    at = np.array([v for _, v in rows])
    far = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    ids = np.arange(200)
    wind = np.minimum(np.abs(ids[:, None] * 7 % 50 - ids[None] * 7 % 50) / 100.0, 1.0)
    d = w["feature"] * far / (far.max(1)[:, None] + 1e-8) + w["class"] * (ids[:, None] % 3 != ids[None] % 3) + w["intensity"] * wind
    np.fill_diagonal(d, np.inf)
    for i in range(200):
        order = np.lexsort((ids, d[i]))[:4]
        assert [d[i, j] for j in order] == pytest.approx([got[i, rank][1] for rank in range(4)], abs=1e-8)


def test_paths_by_raster(spark, monkeypatch):
    """Tracks in several regions: the raster and the boxes leave out pairs, and lose none."""
    monkeypatch.setattr(pruned, "LEAST_BLOCK", 5)
    r = np.random.default_rng(4)
    rows, lines = [], {}
    for t in range(60):
        at = r.uniform(-1, 1, 2) * 20 + (t % 6) * 1000
        line = at + np.cumsum(r.normal(size=(1 if t == 7 else int(r.integers(2, 30)), 2)) * 10, axis=0)
        lines[t] = line
        rows += [(t, i, float(x), float(y)) for i, (x, y) in enumerate(line)]
    df = spark.createDataFrame(rows, "t long, i long, x double, y double")
    got = {(x["query_id"], x["rank"]): (x["item_id"], x["distance"]) for x in paths.path_distance(df, df, track="t", order_by="i", k=4).collect()}

    def mean(a, b):
        def one(p):
            best = np.inf
            for s, e in zip(b, [*b[1:], b[-1]]):
                d = e - s
                n = d @ d
                t = np.clip((p - s) @ d / n, 0, 1) if n > 1e-12 else 0.0
                best = min(best, np.hypot(*(p - s - t * d)))
            return best
        return np.mean([one(p) for p in a])

    far = {(a, b): round(0.5 * (mean(lines[a], lines[b]) + mean(lines[b], lines[a])), 9) for a in lines for b in lines if a != b}
    for a in lines:
        order = sorted((far[a, b], b) for b in lines if b != a)[:4]
        assert [(b, round(d, 6)) for d, b in order] == [(got[a, k][0], round(got[a, k][1], 6)) for k in range(4)]


def grid_tracks(n, side, seed=5):
    r = np.random.default_rng(seed)
    lines = [r.integers(0, side, (int(r.integers(1, 15)), 2)) * 10.0 for _ in range(n)]
    return pd.DataFrame({
        "_key": np.arange(n), "_x": [v[:, 0] for v in lines], "_y": [v[:, 1] for v in lines], "_bound": np.nan,
    })


def test_raster_work(monkeypatch):
    """Tracks over the points of a grid: what is measured grows with the tracks, not with their pairs."""
    plain, work = paths._squared, []
    monkeypatch.setattr(paths, "_squared", lambda p, lines: work.append(len(p) * len(lines[0])) or plain(p, lines))
    each = {}
    for n in (400, 1600):
        rows = grid_tracks(n, 16)
        work.clear()
        assert len(paths._raster_top(rows, rows, 5, True)) == 5 * n
        each[n] = sum(work) / n
    assert each[1600] < 1.5 * each[400]


@pytest.mark.parametrize("room, side", [(16_000_000, 16), (40_000, 16), (16_000_000, 4), (16_000_000, 10_000)])
def test_raster_finds_all(monkeypatch, room, side):
    """Cells of single points, a field in pieces, more points than cells, and a raster over points that differ."""
    monkeypatch.setattr(paths, "_FIELD", room)
    monkeypatch.setattr(paths, "_PAIRS", 5_000)
    rows = grid_tracks(150, side)
    own = paths._Lines(rows)
    far = np.stack([paths._mean_apart(own, i, own, np.arange(150)) for i in range(150)])
    np.fill_diagonal(far, np.inf)
    order = np.stack([np.lexsort((np.arange(150), row))[:5] for row in far])
    for bound in (np.nan, np.take_along_axis(far, order, 1)[:, 4]):
        found = paths._raster_top(rows.assign(_bound=bound), rows, 5, True).sort_values(["query_id", "distance", "item_id"])
        assert (found["item_id"].to_numpy(int).reshape(150, 5) == order).all()
        assert (found["distance"].to_numpy().reshape(150, 5) == np.take_along_axis(far, order, 1)).all()


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 1e4), (1e40, 0.0)])
def test_single_precision_finds_all(scale, shift):
    """Candidates from sums of single precision hold the k nearest, whatever the numbers' size; a vector without a number has none."""
    r = np.random.default_rng(7)
    at = r.normal(size=(700, 8)) * scale + shift
    at[300:310] = at[5]
    at[17, 3] = np.nan
    rows = np.array([i for i in range(60) if i != 17])
    with np.errstate(over="ignore"):
        far = np.sqrt(((at[rows][:, None] - at[None]) ** 2).sum(2))
    far[np.arange(len(rows)), rows] = np.inf
    far = np.where(np.isnan(far), np.inf, far)
    order = np.stack([np.lexsort((np.arange(700), row))[:6] for row in far])
    edge = np.take_along_axis(far, order, 1)
    for bound in (np.full(len(rows), np.inf), edge[:, 5]):
        q = {"vector": at[rows], "bound": bound, "self": (np.arange(len(rows)), rows)}
        one, other, d = neighbours.euclid(q, {"vector": at}, 6)
        for i in range(len(rows)):
            mine = one == i
            best = np.lexsort((other[mine], d[mine]))[:6]
            assert (other[mine][best] == order[i]).all() and (d[mine][best] == edge[i]).all()


def test_few_distances_are_worked_out(monkeypatch):
    """Vectors at hardly differing distances: a query's exact distances are few, and no matrix of double precision is made."""
    monkeypatch.setattr(neighbours, "rough_squares", None)
    at = np.random.default_rng(8).normal(size=(6000, 64))
    q = {"vector": at[:200], "bound": np.full(200, np.inf), "self": (np.arange(200), np.arange(200))}
    assert 5 * 200 <= len(neighbours.euclid(q, {"vector": at}, 5)[0]) < 30 * 200


def test_blocks_of_cells():
    """Rows find the blocks of their cells together, as one product; a large cell has several, neighbours share one."""
    cells = pruned.Cells(np.zeros((4, 1)), *[np.zeros(4)] * 2, {}, np.array([0, 0, 1, 4]), np.array([1, 1, 3, 1]))
    wanted = np.array([[1, 0, 0, 0], [0, 1, 1, 0], [0, 0, 0, 0], [1, 1, 1, 1]], bool)
    assert [np.flatnonzero(r).tolist() for r in cells.blocks_of(wanted)] == [[0], [0, 1, 2, 3], [], [0, 1, 2, 3, 4]]
