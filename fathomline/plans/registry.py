"""Every operator a composed plan may name, with the options it takes.

Two kinds: a transform is (DataFrame, options) -> DataFrame; a model also returns
a one-row DataFrame of metrics. Every entry checks its options by name and type, its
further inputs by name and, where it says which options name columns, those too.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fathomline.functions import values as V
from fathomline.operators import aggregate, charts, joins, reshape, rows, windows

TRANSFORM, MODEL = "transform", "model"
# What an option may hold, by the annotation of the function that takes it.
TYPES = {"int": int, "float": (int, float), "str": str, "bool": bool, "list": (list, tuple), "dict": dict,
         "None": type(None)}


def _fits(value, annotation) -> bool:
    kinds = [k.strip() for k in re.sub(r"\[.*\]", "", str(annotation)).split("|")]
    if any(k not in TYPES for k in kinds):
        return True
    if isinstance(value, bool):
        return "bool" in kinds
    return any(isinstance(value, TYPES[k]) for k in kinds)


@dataclass(frozen=True)
class Entry:
    key: str
    kind: str
    fn: Callable
    inputs: tuple[str, ...]
    options: dict[str, inspect.Parameter]
    # Inputs that must be given, and options that name columns of the main input.
    needed: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def check(self, options: dict) -> None:
        """Name what is unknown or missing before any plan is built."""
        unknown = sorted(set(options) - set(self.options))
        if unknown:
            raise ValueError(f"{self.key} has no option {unknown}; it takes {sorted(self.options)}")
        missing = sorted(
            n for n, p in self.options.items()
            if p.default is inspect.Parameter.empty and n not in options
        )
        if missing:
            raise ValueError(f"{self.key} needs {missing}")
        wrong = sorted(n for n, v in options.items() if not _fits(v, self.options[n].annotation))
        if wrong:
            kinds = {n: str(self.options[n].annotation) for n in wrong}
            raise ValueError(f"{self.key} takes other types of options: {kinds}")

    def check_inputs(self, given) -> None:
        """The inputs beside the main one, by name."""
        unknown = sorted(set(given) - set(self.inputs[1:]))
        missing = sorted(set(self.needed[1:]) - set(given))
        if unknown or missing:
            raise ValueError(f"{self.key} reads {list(self.inputs[1:])}: unknown {unknown}, missing {missing}")

    def check_dataset(self, df: DataFrame, options: dict) -> None:
        """The columns that options name exist in the main input; nothing is computed for it."""
        for n in self.columns:
            value = options.get(n, self.options[n].default)
            if value is not None and value is not inspect.Parameter.empty:
                V.need(df, *[c.lstrip("-") for c in V.names(value)])


REGISTRY: dict[str, Entry] = {}


def register(fn: Callable, key: str | None = None, kind: str = TRANSFORM, columns: tuple[str, ...] = ()) -> Callable:
    parameters = inspect.signature(fn).parameters
    inputs = tuple(
        n for n, p in parameters.items() if p.kind is inspect.Parameter.POSITIONAL_OR_KEYWORD
    )
    needed = tuple(n for n in inputs if parameters[n].default is inspect.Parameter.empty)
    options = {n: p for n, p in parameters.items() if p.kind is inspect.Parameter.KEYWORD_ONLY}
    name = key or fn.__name__
    if name in REGISTRY:
        raise ValueError(f"operator {name!r} is registered twice")
    REGISTRY[name] = Entry(name, kind, fn, inputs, options, needed, columns)
    return fn


def lookup(key: str) -> Entry:
    if key not in REGISTRY:
        raise ValueError(f"no operator {key!r}; known are {sorted(REGISTRY)}")
    return REGISTRY[key]


for _fn in (
    rows.select_columns, rows.drop_columns, rows.rename_columns, rows.cast_types,
    rows.fill_missing, rows.filter_rows, rows.flag_rows, rows.explore_filter, rows.explore_query,
    rows.formula, rows.rule, rows.parse_numeric, rows.extract_pattern, rows.datetime_parts,
    rows.duration_between, rows.bin_numeric, rows.map_values, rows.sort_rows, rows.limit_rows,
    rows.page, rows.drop_duplicates, rows.latest_per_key, rows.top_per_group, rows.rank_rows,
    joins.join, joins.as_of, joins.as_of_one, joins.within_intervals, joins.look_ahead,
    joins.within_distance,
    aggregate.group_aggregate, aggregate.summarise, aggregate.explore_aggregate,
    aggregate.profile, aggregate.value_counts, aggregate.percent_of_total,
    aggregate.zscore_outliers, aggregate.linear_trend, aggregate.correlation,
    aggregate.confusion_rates, aggregate.class_accuracy, aggregate.confusion_pairs,
    aggregate.weighted_aggregate,
    windows.moving_average, windows.rolling_stats, windows.lag_column, windows.rate_of_change,
    windows.trailing_rows, windows.longest_runs, windows.level_shift, windows.sampling_gaps,
    windows.half_drift, windows.arc_points,
    reshape.pivot_wider, reshape.unpivot_longer, reshape.resample_time,
    charts.plain_series, charts.aggregated_series, charts.histogram, charts.distribution,
    charts.box, charts.box_outliers, charts.grid,
):
    register(_fn)


def _models() -> None:
    from fathomline.models import curve, evidence, learning, matrix, outcomes, projection, quality, scorecard

    for fn in (
        scorecard.scorecard, matrix.risk_matrix, projection.project, quality.data_quality,
        outcomes.distribution_summary, outcomes.outcome_histogram, outcomes.scan_grid,
        evidence.evidence_bundle, evidence.compose_reasoning, evidence.unsupported_citations,
    ):
        register(fn)
    register(curve.fit_curve, kind=MODEL)
    register(learning.train_model, columns=("target", "features"))
    register(learning.apply_model)


def _tracks() -> None:
    from fathomline.tracks import classes, neighbours, paths

    place = ("track", "order_by", "lat", "lon")
    register(paths.clip_tracks, columns=place)
    register(paths.track_features, columns=("track", "time", "lat", "lon", "wind", "pressure", "place"))
    register(paths.path_distance, columns=("track", "order_by", "x", "y"))
    register(paths.warped_distance)
    register(classes.crossing_features, columns=(*place, "place"))
    register(classes.classify)
    register(classes.rule_similarity, columns=("key", "vector", "label", "wind"))
    register(neighbours.nearest, columns=("key", "vector"))
    register(neighbours.random_analogs, columns=("key",))
    register(neighbours.difference_ranks, columns=("key", "value"))
    for fn in (neighbours.vote, neighbours.leave_one_out, neighbours.path_fusion, neighbours.combined_fusion):
        register(fn)


def _condition() -> None:
    from fathomline.condition import assess, features

    for fn in (
        features.condition_readings, features.daily_readings, features.residuals, features.trends,
        features.fleet_snapshot, assess.maintenance_decisions, assess.fleet_summary,
    ):
        register(fn)


_models()
_tracks()
_condition()
