"""The distance join and the rain that rests on it."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import values as V
from fathomline.operators import joins
from fathomline.tracks import rainfall


def test_a_distance_join_writes_rows_and_no_vectors(spark):
    """A row of the history goes to few cells, a query to one, and neither takes its unit vector along."""
    p = spark.range(3000).selectExpr("id", "double(id * 53 % 1200) / 10 - 60 AS lat", "double(id * 37 % 3600) / 10 - 180 AS lon")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = joins.within_distance(p, p, cutoff_km=450)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    at = [i for i, x in enumerate(plan) if "REPARTITION_BY_NUM" in x]
    assert len(at) == 2 and all("SIN(" not in x for i in at for x in plan[i:i + 3])
    assert "SortMergeJoin" in "".join(plan) or "BroadcastHashJoin" in "".join(plan)


@pytest.mark.parametrize("cutoff", [0.0, 0.5, 60.0, 900.0, 9000.0, 20000.0])
def test_pairs_on_all_sides_of_the_globe_are_found(spark, monkeypatch, cutoff):
    monkeypatch.setattr(joins, "_LEAST", 7, raising=False)
    monkeypatch.setattr(joins, "_MOST", 7, raising=False)
    rng = np.random.default_rng(5)
    at = [(90.0, 0.0), (-90.0, 10.0), (89.999, 179.9), (89.999, -0.1), (0.0, -180.0), (0.0, 180.0), (0.001, 179.999), (45.0, 360.0),
          (45.0, 0.0), (45.0, -180.00000000000003), (12.0, 7.0), (12.0, 7.0), (12.004, 7.0)]
    at += [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60))]
    rows = [(i, *x) for i, x in enumerate(at)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, float("nan"))]
    p = spark.createDataFrame(rows, "id int, lat double, lon double")
    la, lo = np.radians(np.array(at)).T[:, :, None]
    chord = np.sin((la - la.T) / 2) ** 2 + np.cos(la) * np.cos(la.T) * np.sin((lo - lo.T) / 2) ** 2
    far = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(chord, 1)))
    got = joins.within_distance(p, p, cutoff_km=cutoff).collect()
    assert sorted((r["id"], r["id_h"]) for r in got) == sorted(map(tuple, np.argwhere(far <= cutoff).tolist()))
    assert [r["distance_km"] for r in got] == pytest.approx([far[r["id"], r["id_h"]] for r in got], abs=1e-6)


def test_half_up_is_round(spark):
    df = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN id * 0.00005 WHEN id % 3 = 1 THEN pow(id * 0.731, 2) ELSE id / 7.0 - 900 END AS x")
    df = df.unionByName(spark.sql("SELECT explode(array(double('nan'), double('inf'), null, 0.00005D, 1e300D, -0.00005D)) AS x"))
    assert df.where(~V.half_up(F.col("x"), 4).eqNullSafe(F.round("x", 4))).count() == 0


def test_rain_is_summed_where_points_meet_moments(spark, monkeypatch):
    """Above the distance join only rows of a point and cell are shuffled, never its pairs."""
    monkeypatch.setattr(rainfall, "_FIELD", 2, raising=False)
    steps = spark.createDataFrame([(1, 10.0, 120.0, 30.0), (1, 11.0, 121.0, 10.0), (2, 10.5, 120.5, None), (3, -50.0, 0.0, 5.0), (None, 10.0, 120.0, 1.0)],
                                  "step int, lat double, lon double, wind_kt double")
    moments = spark.createDataFrame([(1, 10.2, 120.1, 20.0), (2, 11.2, 121.0, None), (2, 11.3, 121.0, 40.0), (3, 10.0, 120.0, 1.0), (None, 10.0, 120.0, 1.0)],
                                    "moment_id int, storm_lat double, storm_lon double, storm_wind double")
    fields = spark.createDataFrame([(1, c, float(c * 7)) for c in range(5)] + [(2, 3, None), (2, 4, 30.0), (2, 4, 31.0), (None, 4, 9.0), (9, 4, 9.0)],
                                   "moment_id int, cell_id int, rain_mm_h double")
    out = rainfall.conditioned_rain(steps, moments, fields, step="step", thresholds=[25])
    sums = defaultdict(list)
    for step, la, lo, wind in steps.collect():
        for moment, la2, lo2, wind2 in moments.collect():
            x, y, z, w = map(math.radians, (la, la2, lo, lo2))
            far = 2 * 6371.0 * math.asin(math.sqrt(math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin((w - z) / 2) ** 2))
            weight = math.exp(-0.5 * (far / 150) ** 2) * (math.exp(-0.5 * ((wind2 - wind) / 25) ** 2) if wind is not None and wind2 is not None else 1)
            for cell, rain in [(r[1], r[2]) for r in fields.collect() if r[0] == moment and moment is not None and far <= 450]:
                sums[step, cell].append((rain, weight))
    got = {(r["step"], r["cell_id"]): r for r in out.collect()}
    assert set(got) == set(sums)
    for k, pairs in sums.items():
        held = [(v, w) for v, w in pairs if v is not None]
        whole = sum(w for _, w in held)
        assert got[k]["samples"] == len(held)
        assert got[k]["expected"] == pytest.approx(sum(v * w for v, w in held) / whole if held else 0.0)
        assert got[k]["prob_25"] == pytest.approx(sum(w for v, w in held if v >= 25) / whole if held else 0.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rainfall.conditioned_rain(steps, moments, fields, step="step")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    above = plan[:next(i for i, x in enumerate(plan) if "Join [_row" in x)]
    assert sum("Exchange" in x for x in above) == 1
