"""States at many moments against a plain walk over the whole history."""

import random
from datetime import datetime, timedelta

import pytest

from fathomline.condition.views import facts, intervals

START = datetime(2024, 1, 1)
MOMENTS = [START + timedelta(days=d, hours=h) for d, h in ((-1, 0), (0, 0), (0, 5), (4, 0), (9, 12), (9, 13), (40, 0), (400, 0))]
POLICIES = [("P1", "T", "oil", "lube", 100.0, 10.0), ("P2", "T", "belt", "", 0.0, 0.0), ("P3", "U", "oil", "lube", 50.0, 5.0)]


@pytest.fixture(scope="module")
def history():
    draw = random.Random(4)
    days, work = [], []
    for asset in "abcd":
        for day in sorted(draw.sample(range(45), 2 if asset == "b" else 20)):
            for parameter in draw.sample("pqr", draw.randint(1, 3)):
                days.append((asset, parameter, f"{START + timedelta(days=day):%Y-%m-%d}",
                             draw.choice([None, 10.0 * day + draw.random()]), draw.randint(1, 24)))
        if asset != "c":
            for _ in range(12):
                at = draw.choice([None, START + timedelta(days=draw.randint(-3, 41), hours=draw.choice([0, 12]))])
                work.append((asset, at, draw.choice(["corrective", "preventive", None]),
                             draw.choice(["oil", "belt", "wash", None]), draw.choice(["lube", "", None])))
    days.append(("a", "p", None, 5.0, 3))
    return days, work * 2


@pytest.fixture(scope="module")
def tables(spark, history):
    days, work = history
    return (
        spark.createDataFrame(days, "asset_id string, parameter string, day string, runtime_hours_total_max double, sample_count long"),
        spark.createDataFrame(work, "asset_id string, maintenance_date timestamp, maintenance_type string, task string, action_kind string"),
        spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "U"), ("d", "U")], "asset_id string, asset_type string"),
        spark.createDataFrame(POLICIES, "policy_id string, asset_type string, task string, action_kind string, interval_hours double, interval_days double"),
    )


def _seen(days, asset, moment):
    rows = [r for r in days if r[0] == asset and r[2] and datetime.fromisoformat(r[2]) <= moment]
    by_day = {}
    for r in rows:
        by_day.setdefault(r[2], []).append(r)
    if not by_day:
        return None
    first = min(r[1] for r in rows)
    recent = sorted(by_day, reverse=True)[: min(7, len(by_day) - 1)]
    least = [min(by_day[d], key=lambda r: r[1]) for d in recent]
    return (len(by_day), max(r[3] or 0.0 for r in rows), float(sum(r[4] for r in least if r[1] == first)))


def test_facts(tables, history):
    days, work = history
    expected = {}
    for asset in "abcd":
        for m in MOMENTS:
            seen = _seen(days, asset, m)
            if seen:
                fixed = [w[1] for w in work if w[0] == asset and w[2] == "corrective" and w[1] and w[1] <= m]
                expected[asset, m] = (*seen, len(fixed), (m - max(fixed)).days if fixed else None)
    got = {
        (r.asset_id, r.as_of): (r.observed_days, r.runtime_hours_total, r.runtime_hours_7d, r.corrective_count, r.days_since_repair)
        for r in facts(tables[0], tables[1], MOMENTS).collect()
    }
    assert got == expected and len(expected) > 20


def test_intervals(tables, history):
    days, work = history
    known = facts(tables[0], tables[1], MOMENTS)
    kind = dict(a="T", b="T", c="U", d="U")
    expected = {}
    for asset in "abcd":
        for m in MOMENTS:
            if not _seen(days, asset, m):
                continue
            for policy, of, task, action, hours, _ in POLICIES:
                if of == kind[asset]:
                    done = [w[1] for w in work if w[0] == asset and w[1] and w[1] <= m and (
                        w[2] == "corrective" or (w[3] == task and task) or (w[4] == action and action))]
                    expected[asset, m, policy] = (max(done, default=None), hours > 0 and not done)
    out = intervals(known, tables[2], tables[3], tables[1], MOMENTS).collect()
    assert len(out) == len(expected)
    assert {(r.asset_id, r.as_of, r.policy_id): (r.last_done, r.unrecorded) for r in out} == expected


def test_history_is_not_multiplied(spark, tables):
    """A thousand moments before all rows add none, and a thousand after the last take one state each."""
    many = [START + timedelta(days=-5000 + d) for d in range(1000)]
    assert facts(tables[0], tables[1], many).count() == 0
    plan = facts(tables[0], tables[1], MOMENTS)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):].split("\n")
    # Days reach the moments as states, behind the aggregate and the running window.
    assert any("Window" in x for x in below) and not any("Generate" in x and "Relation" in x for x in below)


def test_empty(tables):
    features, work, assets, policies = tables
    assert facts(features.limit(0), work, MOMENTS).count() == 0
    known = facts(features, work.limit(0), MOMENTS)
    assert known.where("days_since_repair IS NOT NULL OR corrective_count > 0").count() == 0
    assert intervals(known, assets, policies, work.limit(0), MOMENTS).where("last_done IS NOT NULL").count() == 0
