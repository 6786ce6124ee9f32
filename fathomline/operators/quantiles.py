"""Exact, linearly interpolated quantiles that do not gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomline.functions.values import names
from fathomline.session import HOT_ROWS, has_hot_group, setting, settle

# Of a sketch: a rank it tells is at most a ten-thousandth of the rows off.
_ACCURACY = 10_000
# Evenly spaced ranks that a round asks of the values left in a bracket.
_STEPS = 1_000
# One rank of a bracket whose other rank lies outside could only come from a faulty sketch.
_MISSED = "a quantile's rank fell outside its bracket"


def quantiles(
    df: DataFrame,
    value: Column,
    probabilities: list[float],
    *,
    group_by=None,
    output: str = "quantiles",
    blocks: bool | None = None,
) -> DataFrame:
    """One row per group: the group columns and an array of quantiles.

    Usually that is the built-in exact `percentile`. Its buffer holds a group's distinct values, so where a
    group is hot each wanted rank is bracketed by a sketch of the group, and brackets that still hold more
    distinct values than a task should order are cut by further rounds, each a map-side combined pass that
    leaves under a hundredth. The values inside are counted and ordered, one bracket a task. A bracket that
    does not hold its rank ends the job. Nulls do not count; a group without values gets null.
    """
    groups = names(group_by)
    by = [F.col(f"`{g}`") for g in groups]
    base = df.select(*by, value.alias("_v"))
    if blocks is None:
        blocks = has_hot_group(df, groups)
    if not blocks:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        return base.groupBy(*by).agg(F.percentile("_v", wanted).alias(output))
    return _bracketed(base, groups, probabilities, output)


def _bracketed(base: DataFrame, groups: list[str], probabilities: list[float], output: str) -> DataFrame:
    keys = [f"_g{i}" for i in range(len(groups))]
    # Edges of brackets rise with the probability, which the counting below relies on.
    asked, probabilities = probabilities, sorted(set(probabilities))
    present = base.where("_v IS NOT NULL").select(
        *[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)], F.col("_v").cast("double").alias("_v")
    )
    brackets = _brackets(present, keys, probabilities)
    joined = _with_state(present, brackets, keys)
    spots = range(len(probabilities))
    inside = [F.col("_v").between(F.col("_lo")[i], F.col("_hi")[i]) for i in spots]
    anywhere = inside[0]
    for c in inside[1:]:
        anywhere = anywhere | c
    # Each distinct value inside a bracket is counted. The others only tell how many lie below which
    # brackets: edges rise with the probability, so one number says it and one row a group and number is left.
    above = sum(F.when(F.col("_v") < F.col("_lo")[i], 0).otherwise(1) for i in spots)
    held = F.when(anywhere, F.col("_v"))
    counted = joined.groupBy(*keys, above.alias("_above"), held.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted = _with_state(counted, brackets, keys)
    visits = F.array(*[
        F.when(
            F.col("_v").isNull() & (F.col("_above") <= i) | (F.col("_v") < F.col("_lo")[i]),
            F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v")),
        ).when(
            F.col("_v").between(F.col("_lo")[i], F.col("_hi")[i]),
            F.struct(F.lit(i).alias("i"), F.col("_v").alias("v")),
        )
        for i in spots
    ])
    each = counted.select(*keys, "_n", "_c", F.explode(F.array_compact(visits)).alias("_e")).select(
        *keys, "_n", "_c", "_e.*"
    )
    run = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rangeBetween(
        Window.unboundedPreceding, 0
    )
    at = F.array(*[F.lit(float(p)) for p in probabilities])[F.col("i")] * (F.col("_n") - 1)
    ranked = each.withColumns({"_upto": F.sum("_c").over(run), "_h": at})
    low, high = F.floor("_h"), F.ceil("_h")
    found = ranked.groupBy(*keys, "i").agg(
        F.min(F.when(F.col("_upto") > low, F.col("v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > high, F.col("v"))).alias("_b"),
        F.max(F.when(F.col("v").isNull(), F.col("_upto") > low)).alias("_under"),
        F.max("_h").alias("_h"),
    )
    missed = F.col("_a").isNull() | F.col("_b").isNull() | F.coalesce("_under", F.lit(False))
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        (high - F.col("_h")) * F.col("_a") + (F.col("_h") - low) * F.col("_b")
    )
    value = F.when(missed, F.raise_error(F.lit(_MISSED)).cast("double")).otherwise(between)
    entries = F.array_sort(F.collect_list(F.struct("i", value.alias("q"))))
    answer = F.array(*[entries[probabilities.index(p)]["q"] for p in asked])
    if not groups:
        return found.agg(F.when(F.count(F.lit(1)) > 0, answer).alias(output))
    found = found.groupBy(*keys).agg(answer.alias(output))
    # Groups without a single value still get their row.
    everyone = base.groupBy(*[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)]).agg(F.lit(1).alias("_any"))
    pairs = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return everyone.alias("a").join(found.alias("b"), pairs, "left").select(
        *[F.col(f"a.{k}").alias(g) for k, g in zip(keys, groups)], output
    )


def _with_state(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return rows.withColumn("_state", state.select(F.struct("*")).scalar()).select("*", "_state.*").drop("_state")
    named = state.withColumnsRenamed({k: f"{k}s" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys]
    return rows.join(named, same).drop(*[f"{k}s" for k in keys])


def _brackets(present: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """Per group: the number of values, and a low and a high edge around each wanted rank.

    The driver sees one number a round: how many distinct values the fullest bracket may hold.
    """
    limit = max(setting(present.sparkSession, HOT_ROWS), 1)
    spots = range(len(probabilities))
    ends = [F.lit(min(1.0, max(0.0, p + s * 3.0 / _ACCURACY))) for p in probabilities for s in (-1, 1)]
    sketch = present.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.approx_count_distinct("_v").alias("_d"),
        F.percentile_approx("_v", F.array(*ends), _ACCURACY).alias("_e"),
    )
    # A small group is a bracket as a whole; its rows are fewer than a sketch's slack is worth.
    few = F.col("_n") <= 4 * _ACCURACY
    state = settle(sketch.select(
        *keys, "_n",
        F.array(*[F.when(few, F.col("_min")).otherwise(F.col("_e")[2 * i]) for i in spots]).alias("_lo"),
        F.array(*[F.when(few, F.col("_max")).otherwise(F.col("_e")[2 * i + 1]) for i in spots]).alias("_hi"),
        F.least(F.col("_d"), F.when(few, F.col("_n")).otherwise(F.ceil(F.col("_n") * (12 / _ACCURACY)))).alias("_most"),
    ))
    grid = F.array(*[F.lit(j / _STEPS) for j in range(_STEPS + 1)])
    while (state.agg(F.max("_most")).first()[0] or 0) > max(limit, 4 * _ACCURACY):
        state = settle(_cut(present, state, keys, probabilities, grid))
    return state


def _cut(present: DataFrame, state: DataFrame, keys: list[str], probabilities: list[float], grid) -> DataFrame:
    """One more round: what lies below and inside each bracket, and the narrower one around its ranks."""
    joined = _with_state(present, state, keys)
    made = [F.first(c).alias(c) for c in ("_n", "_lo", "_hi")]
    for i in range(len(probabilities)):
        held = F.when(F.col("_v").between(F.col("_lo")[i], F.col("_hi")[i]), F.col("_v"))
        made += [
            F.count_if(F.col("_v") < F.col("_lo")[i]).alias(f"_below{i}"), F.count(held).alias(f"_in{i}"),
            F.approx_count_distinct(held).alias(f"_d{i}"),
            F.percentile_approx(held, grid, _ACCURACY).alias(f"_e{i}"),
        ]
    told = joined.groupBy(*keys).agg(*made).where("_n IS NOT NULL")
    lows, highs, most = [], [], []
    for i, p in enumerate(probabilities):
        h, held = F.lit(float(p)) * (F.col("_n") - 1), F.col(f"_in{i}")
        # One step aside covers what the sketch may be off; steps are ten times as wide.
        first = F.floor((F.floor(h) - F.col(f"_below{i}")) / held * _STEPS).cast("int") - 1
        last = F.ceil((F.ceil(h) + 1 - F.col(f"_below{i}")) / held * _STEPS).cast("int") + 1
        edges = F.col(f"_e{i}")
        few = held <= 4 * _ACCURACY
        lows.append(F.when(few | (first < 0), F.col("_lo")[i]).otherwise(F.get(edges, first)))
        highs.append(F.when(few | (last > _STEPS), F.col("_hi")[i]).otherwise(F.get(edges, last)))
        most.append(F.least(F.col(f"_d{i}"), F.when(few, held).otherwise(F.ceil(held * (6 / _STEPS)))))
    return told.select(
        *keys, "_n", F.array(*lows).alias("_lo"), F.array(*highs).alias("_hi"),
        F.array_max(F.array(*most)).alias("_most"),
    )
