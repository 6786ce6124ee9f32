import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.catalog import everything
from fathomline.models import curve, evidence, learning, matrix, outcomes, projection, quality
from fathomline.operators import joins
from fathomline.models.scorecard import scorecard
from fathomline.tracks import classes, neighbours, paths
from tests.oracle import difference


def test_scorecard_leaves_absent_weights_out(spark):
    df = spark.createDataFrame([(1, 20.0, 10.0), (2, None, 5.0), (3, None, None)], "id int, wear double, spares double")
    card = [{"name": "wear", "column": "wear", "weight": 3, "good": 0, "bad": 100},
            {"name": "spares", "column": "spares", "good": 20, "bad": 0}]
    rows = {r["id"]: r for r in scorecard(df, components=card, min_coverage=0.2).collect()}
    assert rows[1]["score"] == 72.5 and rows[1]["score_coverage"] == 1.0
    assert rows[2]["score"] == 25.0 and rows[2]["score_coverage"] == 0.25
    assert rows[3]["score"] is None
    assert rows[1]["score_explanation"].startswith("73 points, held down by spares 50/100 (spares = 10)") or \
        rows[1]["score_explanation"].startswith("72 points, held down by spares 50/100 (spares = 10)")
    with pytest.raises(ValueError, match="good and bad"):
        scorecard(df, components=[{"column": "wear"}])


def test_matrix_refuses_unknown_levels(spark):
    df = spark.createDataFrame([(5.0, "odd")], "p double, harm string")
    options = dict(likelihood={"column": "p", "levels": ["a", "b"], "bands": [1]},
                   consequence={"column": "harm", "levels": ["x", "y"]}, grid=[["l", "m"], ["m", "h"]])
    with pytest.raises(Exception, match="no such level"):
        matrix.risk_matrix(df, **options).collect()
    with pytest.raises(ValueError, match="2 by 2"):
        matrix.risk_matrix(df, **{**options, "grid": [["l", "m"]]})


def test_projection_bases(spark):
    rows = []
    for i in range(10):
        rows += [("past", f"2024-01-{i + 1:02d}", 90.0 + i * 2), ("clean", f"2024-01-{i + 1:02d}", 10.0 + i),
                 ("away", f"2024-01-{i + 1:02d}", 50.0 - i),
                 ("noisy", f"2024-01-{i + 1:02d}", 10.0 + 0.1 * i + (8 if i % 2 else -8))]
    df = spark.createDataFrame(rows, "g string, day string, v double")
    out = {r["g"]: r for r in projection.project(
        df, value="v", time="day", group_by="g", limits=[{"name": "limit", "value": 100}]).collect()}
    assert {g: r["basis"] for g, r in out.items()} == {
        "past": "calculated", "clean": "estimated", "away": "unknown", "noisy": "inferred"}
    assert out["clean"]["days_to_limit"] == 81.0 and out["clean"]["projected_date"] == "2024-03-31"
    assert out["noisy"]["projected_date"] is None


def test_quality_flags_a_stuck_instrument_not_a_duty_cycle(spark):
    rows = []
    for i in range(160):
        stamp = f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00"
        wobble = math.sin(i * 1.7) + 0.3 * math.sin(i * 5.1)
        rows.append(("clean", stamp, 50 + wobble))
        rows.append(("stuck", stamp, 50.0 if 60 <= i < 100 else 50 + wobble))
        rows.append(("rescaled", stamp, 50 + wobble if i < 80 else 122 + wobble))
        rows.append(("duty", stamp, (80 if i % 24 < 12 else 20) + wobble))
    df = spark.createDataFrame(rows, "s string, ts string, v double")
    out = {r["s"]: r for r in quality.data_quality(
        df, value="v", timestamp="ts", group_by="s", expected_interval_minutes=60).collect()}
    assert out["clean"]["quality_score"] == 100.0 and out["clean"]["issues"] == ""
    assert out["stuck"]["longest_flatline"] == 40 and out["stuck"]["quality_score"] <= 60
    assert out["rescaled"]["largest_step_ratio"] > 12
    assert out["duty"]["quality_flag"] == "good"


def test_curves_find_their_own_coefficients(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x + 5, 2 * x * x - x + 1.0, 2.0 * math.exp(0.3 * x)) for x in range(1, 11)],
                               "x double, line double, bend double, grow double")
    row = curve.fit_curve(df, x="x", y="line", predict_for=[20])[1].first()
    assert (row["slope"], row["intercept"], row["r_squared"], row["predictions"]) == (3.0, 5.0, 1.0, [65.0])
    row = curve.fit_curve(df, x="x", y="bend", family="polynomial")[1].first()
    assert (row["c2"], row["c1"], row["c0"]) == (2.0, -1.0, 1.0)
    row = curve.fit_curve(df, x="x", y="grow", family="exponential")[1].first()
    assert (row["a"], row["b"]) == (2.0, 0.3)
    assert curve.equation("linear", [3.0, 5.0]) == "y = 3·x + 5"


def test_all_seven_algorithms_learn(spark):
    df = spark.range(60).select(
        (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        ((F.col("id") % 10) * 3.0 + 5).alias("y"), F.when(F.col("id") % 10 > 4, "up").otherwise("down").alias("k"))
    for name in learning.REGRESSORS:
        extra = {"maxIter": 5} if name.startswith("gradient") else ({"numTrees": 5} if "forest" in name else {})
        _m, metrics = learning.train(df, algorithm=name, target="y", features="a,b", hyperparameters=extra)
        assert metrics["r2"] > 0.5
    for name in learning.CLASSIFIERS:
        extra = {"numTrees": 5} if "forest" in name else {}
        model, metrics = learning.train(df, algorithm=name, target="k", features="a,b", hyperparameters=extra)
        assert metrics["accuracy"] > 0.8
        out = learning.predict(df.drop("k"), model, features="a,b")
        assert out.count() == 60 and set(r[0] for r in out.select("prediction").distinct().collect()) == {"up", "down"}


def test_reasoning_counts_what_it_leaves_out(spark):
    df = spark.createDataFrame([("s", i, float(i), f"finding {i}") for i in range(6)], "s string, i int, w double, t string")
    bundle = evidence.evidence_bundle(df, subject="s", severity="w", statement="t", order_by="i")
    text = evidence.compose_reasoning(bundle, subject="s").first()["reasoning"]
    assert text.startswith("s: 6 findings") and "- finding 5 [E1]" in text and "A further 2 weaker" in text
    said = spark.createDataFrame([("s", "see [E1] and [E9]")], "s string, a string")
    assert evidence.unsupported_citations(said, bundle, subject="s", text="a").first()["unsupported"] == ["E9"]


def naive_warp(a, b):
    w = np.array([1, 1, 1, 0.5]) / 3.5
    n, m = len(a), len(b)
    band = max(1, int(0.3 * max(n, m)))
    c = np.full((n + 1, m + 1), np.inf)
    c[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            gap = np.abs(a[i - 1] - b[j - 1])
            gap[1] = min(gap[1], 2 * math.pi - gap[1])
            c[i, j] = (w * gap * gap).sum() + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    return math.sqrt(c[n, m] / (n + m))


def test_warp_equals_its_recurrence():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (4, 5), (12, 9), (30, 30)):
        a, b = rng.normal(size=(n, 4)), rng.normal(size=(m, 4))
        assert paths.warp(a, b) == pytest.approx(naive_warp(a, b))
    assert paths.warp(a, a) == 0.0


@pytest.mark.parametrize("blocks", (False, True))
def test_path_distance_is_zero_for_twins_and_symmetric(spark, hot, blocks):
    rows = [(t, i, 10.0 * i, off) for t, off in (("a", 0.0), ("b", 0.0), ("c", 30.0)) for i in range(20)]
    df = spark.createDataFrame(rows, "track string, i int, x double, y double")
    out = {(r["query_id"], r["item_id"]): r["distance"] for r in paths.path_distance(
        df, df, track="track", order_by="i", k=5, blocks=blocks).collect()}
    assert out[("a", "b")] == out[("b", "a")] == 0.0
    assert out[("a", "c")] == out[("c", "a")] == 30.0


def test_nearest_in_many_parts(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    whole = neighbours.nearest(e, e, key="vec_id", vector="embedding", k=4)
    spark.conf.set("fathomline.broadcastBytes", "4096")
    try:
        parts = neighbours.nearest(e, e, key="vec_id", vector="embedding", k=4)
        pick = ["query_id", "item_id", "rank"]
        assert parts.count() == whole.count()
        assert parts.select(pick).exceptAll(whole.select(pick)).count() == 0
    finally:
        spark.conf.unset("fathomline.broadcastBytes")


def test_landfall_zones(spark):
    df = spark.createDataFrame([("宜蘭至花蓮間",), ("花蓮縣",), ("臺東",), ("恆春",), ("高雄",), ("基隆",), ("---",), ("火星",)], "p string")
    got = [r[0] for r in df.select(classes.landfall_zone(F.col("p"))).collect()]
    assert got == ["east_north", "east_central", "east_south", "south_tip", "west_south", "east_north", None, None]


def test_queries_of_trees_hold_out_well(spark, folder):
    """The registered queries score held-out parts, whose price follows their key."""
    queries = everything().queries
    value = {(r[0], r[1]): r[2] for r in queries["train_regressors"](spark, folder).collect()}
    assert {k for k, _ in value} == {"ridge", "random_forest_regressor", "gradient_boosting_regressor"}
    assert value["gradient_boosting_regressor", "r2"] > 0.8
    value = {(r[0], r[1]): r[2] for r in queries["train_classifiers"](spark, folder).collect()}
    assert {k for k, _ in value} == {"random_forest_classifier", "decision_tree_classifier"}
    assert min(v for (_, m), v in value.items() if m == "accuracy") > 0.4


@pytest.mark.parametrize("name", ["evidence_bundle", "compose_reasoning", "unsupported_citations"])
def test_bundles_of_many_findings_equal_their_sql(name, spark, tmp_path):
    docs = spark.range(100).selectExpr("id AS doc_id", "'en' AS lang", "concat('s', id % 2) AS source", "id * 7 AS n_chars")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(95).selectExpr("id AS doc_id", "id % 2 AS quality", "id % 3 % 2 AS toxic").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    catalog = everything()
    assert difference(catalog.queries[name](spark, str(tmp_path)), con, catalog.sql[name]) is None


def test_reasoning_rests_on_every_finding(spark, tmp_path, hot):
    docs = spark.range(100).selectExpr("id AS doc_id", "'en' AS lang", "concat('s', id % 2) AS source", "id * 7 AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(95).selectExpr("id AS doc_id", "id % 2 AS quality", "id % 3 % 2 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    said = dict(everything().queries["compose_reasoning"](spark, str(tmp_path)).collect())
    assert said["s0"].startswith("s0: 48 findings") and "A further 44 weaker" in said["s0"]
    assert said["s1"].startswith("s1: 47 findings") and "A further 43 weaker" in said["s1"]


def test_halves_of_a_missing_share_round_up(spark):
    df = spark.range(320).selectExpr("id", "timestamp_seconds(id * 60) AS at", "CASE WHEN id >= 51 THEN id * 1.0 END AS v")
    row = quality.data_quality(df, value="v", timestamp="at", checks="missing").first()
    assert (row["missing_pct"], row["quality_score"]) == (15.938, 90.44)


def test_pairs_warped_together_equal_their_recurrence():
    rng = np.random.default_rng(2)
    left, right = ([rng.normal(size=(n, 4)) for n in sizes] for sizes in ((1, 12, 30, 5, 0), (1, 9, 31, 40, 3)))
    got = paths.warp_many(left, right)
    assert got == pytest.approx([naive_warp(a, b) if len(a) else math.inf for a, b in zip(left, right)])


def test_a_scan_has_tasks_for_its_candidates(spark, monkeypatch):
    monkeypatch.setattr(outcomes, "TASK_ROWS", 20)
    df = spark.range(100).selectExpr("id", "id % 7 AS base")
    out = outcomes.scan_grid(df, subject="id", variables={"x": [1, 2, 3]}, objective="base * x", top=2)
    assert out.rdd.getNumPartitions() == 15
    assert [(r["rank"], r["x"], r["objective"]) for r in out.where("id = 3").collect()] == [(1, 3, 9.0), (2, 2, 6.0)]


def test_a_small_file_of_positions_makes_its_pairs_in_many_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id", "double(id * 53 % 170 - 85) AS lat", "double(id * 37 % 360 - 180) AS lon").coalesce(1).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    near = joins.within_distance(p, p, cutoff_km=900)
    assert "REPARTITION_BY_NUM" in near._jdf.queryExecution().toString()
    rows = p.collect()
    at = np.radians([(r["lat"], r["lon"]) for r in rows])
    la, lo = at[:, :1], at[:, 1:]
    chord = np.sin((la - la.T) / 2) ** 2 + np.cos(la) * np.cos(la.T) * np.sin((lo - lo.T) / 2) ** 2
    found = {(rows[i]["id"], rows[j]["id"]) for i, j in zip(*np.nonzero(2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(chord, 1))) <= 900))}
    assert {(r["id"], r["id_h"]) for r in near.collect()} == found
