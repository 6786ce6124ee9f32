"""Steps composed into one lazy plan.

A step names an operator, what it reads and its options. The whole list is checked
before anything is built; nothing is written between steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fathomline.plans.registry import MODEL, lookup

DEEPEST = 5


@dataclass
class Step:
    name: str
    use: str
    options: dict = field(default_factory=dict)
    # The main input: an earlier step, or the plan's own input.
    reads: str | None = None
    # Further inputs by parameter name: an earlier step or a table by name.
    inputs: dict[str, str] = field(default_factory=dict)
    materialise: bool = False


class StepFailed(ValueError):
    def __init__(self, step: str, cause: Exception):
        super().__init__(f"step {step!r}: {cause}")
        self.step = step


def _steps(spec: list) -> list[Step]:
    return [s if isinstance(s, Step) else Step(**s) for s in spec]



def ordered_steps(spec: list, tables: set[str] = frozenset()) -> list[tuple[Step, str | None]]:
    """Steps in an order where each follows what it reads; refuses bad specs."""
    steps = _steps(spec)
    names = [s.name for s in steps]
    twice = sorted({n for n in names if names.count(n) > 1})
    if not steps or twice:
        raise ValueError(f"steps need unique names; repeated: {twice}" if steps else "no steps")
    both = sorted(set(names) & set(tables))
    if both:
        raise ValueError(f"{both} name both a step and a table")
    resolved: dict[str, tuple[Step, str | None]] = {}
    for at, s in enumerate(steps):
        main = s.reads if s.reads else (names[at - 1] if at else None)
        if main == "input":
            main = None
        for reference in [main, *s.inputs.values()]:
            if reference is not None and reference not in names and reference not in tables:
                raise ValueError(f"step {s.name!r} reads {reference!r}, which does not exist")
        resolved[s.name] = (s, main)
    done: list[str] = []
    waiting = list(names)
    while waiting:
        ready = [
            n for n in waiting
            if all(
                p in done or p in tables and p not in names
                for p in [resolved[n][1], *resolved[n][0].inputs.values()]
                if p is not None
            )
        ]
        if not ready:
            raise ValueError(f"steps {waiting} read each other in a circle")
        done += ready
        waiting = [n for n in waiting if n not in ready]
    return [resolved[n] for n in done]


def run_plan(
    spec: list,
    source: DataFrame,
    *,
    tables: dict[str, DataFrame] | None = None,
    plans: dict[str, list] | None = None,
    every_step: bool = False,
    _depth: int = 1,
    _open: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """The DataFrames of the last steps and of those marked `materialise`.

    `use: "plan:<name>"` runs another plan of `plans` on the step's input.
    """
    tables = tables or {}
    if _depth > DEEPEST:
        raise ValueError(f"plans are nested deeper than {DEEPEST}")
    todo = ordered_steps(spec, set(tables))
    for step, _ in todo:
        if not step.use.startswith("plan:"):
            try:
                lookup(step.use).check(step.options)
                lookup(step.use).check_inputs(step.inputs)
            except ValueError as e:
                raise StepFailed(step.name, e) from e
    made: dict[str, DataFrame] = {}
    read: set[str] = set()
    for step, main in todo:
        known = {**tables, **made}
        first = source if main is None else known[main]
        extra = {k: known[v] for k, v in step.inputs.items()}
        read |= {p for p in [main, *step.inputs.values()] if p in made}
        try:
            if step.use.startswith("plan:"):
                inner = step.use.removeprefix("plan:")
                if inner in _open:
                    raise ValueError(f"plan {inner!r} contains itself")
                if inner not in (plans or {}):
                    raise ValueError(f"no plan {inner!r}; known are {sorted(plans or {})}")
                ends = run_plan(
                    plans[inner], first, tables={**tables, **extra}, plans=plans,
                    _depth=_depth + 1, _open=(*_open, inner),
                )
                made[step.name] = list(ends.values())[-1]
                continue
            entry = lookup(step.use)
            entry.check_dataset(first, step.options)
            out = entry.fn(first, **extra, **step.options)
            made[step.name] = out[0] if entry.kind == MODEL else out
        except StepFailed as e:
            raise StepFailed(f"{step.name}/{e.step}", e) from e
        except Exception as e:
            raise StepFailed(step.name, e) from e
    if every_step:
        return made
    kept = {s.name for s, _ in todo if s.materialise}
    return {n: df for n, df in made.items() if n not in read or n in kept}


def steps_from_query(
    *, columns=None, conditions: list[dict] | None = None, sort_by: str | None = None,
    descending: bool = False,
) -> list[dict]:
    """An Explore query as the steps that give the same rows."""
    same = {"eq": "equals", "ne": "not_equals", "gt": "gt", "gte": "gte", "lt": "lt", "lte": "lte",
            "in": "in", "is_null": "is_empty", "not_null": "not_empty"}
    out: list[dict] = []
    for i, c in enumerate(conditions or []):
        if c["op"] not in same:
            raise ValueError(f"{c['op']!r} has no filter step; use one of {sorted(same)}")
        options = {"column": c["column"], "op": same[c["op"]]}
        if "value" in c:
            options["value"] = c["value"]
        out.append({"name": f"filter_{i + 1}", "use": "filter_rows", "options": options})
    if sort_by:
        out.append({"name": "sort", "use": "sort_rows",
                    "options": {"column": sort_by, "descending": descending}})
    if columns:
        out.append({"name": "select", "use": "select_columns", "options": {"columns": columns}})
    if not out:
        raise ValueError("the query selects, filters and sorts nothing")
    return out
