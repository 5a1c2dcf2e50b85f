"""Folding a plan's steps over a catalog, and running its last one."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row

from .. import operators as ops
from ..catalog import Catalog
from . import checks
from .checks import Issue
from .recipes import RecipeError, expand

DEFAULT_ROWS = 1000


class PlanError(ValueError):
    """A plan breaks rules; issues has all that were found."""

    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(f"{i.step or 'plan'}: {i.code}: {i.message}" for i in issues))
        self.issues = issues


@dataclass
class Result:
    """What a plan's last step shows: at most row_cap rows, and how many there are."""

    columns: list[str]
    rows: list[Row]
    total_rows: int
    truncated: bool
    format: str = "table"
    title: str | None = None
    samples: dict[str, tuple[int, list[Row]]] = field(default_factory=dict)


def fold(plan: Mapping[str, Any], catalog: Catalog) -> tuple[dict[str, DataFrame], list[Issue], list[dict[str, Any]]]:
    """(DataFrames by step, issues, atomic steps). A step is built only if it and what it reads are sound; nothing is executed."""
    issues = list(checks.plan_issues(plan))
    if issues or plan.get("answerable") is False:
        return {}, issues, []
    try:
        steps = expand(plan["steps"])
    except RecipeError as e:
        return {}, [Issue(f"params.{e.code}", str(e))], []
    built: dict[str, DataFrame] = {}
    totals: set[str] = set()
    for k, step in enumerate(steps):
        name, skill, p = step["id"], step["skill"], step["params"]
        known = lambda ref: ref in built or ref in catalog  # noqa: E731, B023
        found = list(checks.reference_issues(step, known, {s["id"] for s in steps[k:]}))
        if not found:
            of = lambda key: built[p[key]] if p[key] in built else catalog[p[key]]  # noqa: E731, B023
            inputs = [of(key) for key in ("input", "left", "right") if key in checks.NEEDS[skill]]
            if skill == "compare":
                found = list(checks.compare_issues(name, p, *inputs, totals.__contains__))
            else:
                found = list(getattr(checks, f"{skill}_issues")(name, p, *inputs))
        issues += found
        if found:
            continue
        if skill == "filter":
            built[name] = ops.filter_rows(*inputs, p["column"], p["operator"], p.get("value"))
        elif skill == "join":
            built[name] = ops.join(*inputs, p["on"], p.get("how", "inner"))
        elif skill == "aggregate":
            built[name] = ops.aggregate(*inputs, p["group_by"], p["metrics"])
            if not p["group_by"]:
                totals.add(name)
        elif skill == "compare":
            built[name] = ops.compare(*inputs, p["join_key"], p["left_label"], p["right_label"])
        elif skill == "calculate":
            built[name] = ops.calculate(*inputs, p["expressions"])
        elif skill == "sort":
            built[name] = ops.sort(*inputs, p["by"], p.get("order", "desc"), p.get("limit"))
        else:
            built[name] = ops.present(*inputs, p.get("columns"))
    return built, issues, steps


def check_plan(plan: Mapping[str, Any], catalog: Catalog) -> list[Issue]:
    return fold(plan, catalog)[1]


def row_cap(value: Any) -> int:
    """A wished number of rows within what is allowed; anything else is the default."""
    fine = isinstance(value, int) and not isinstance(value, bool) and value > 0
    return min(value, checks.MOST_ROWS) if fine else DEFAULT_ROWS


def frame(plan: Mapping[str, Any], catalog: Catalog) -> DataFrame:
    """The last step's DataFrame, or PlanError."""
    built, issues, steps = fold(plan, catalog)
    if issues or not steps:
        raise PlanError(issues or [Issue("plan.steps_empty", "the plan was refused")])
    return built[steps[-1]["id"]]


def run_plan(plan: Mapping[str, Any], catalog: Catalog, *, debug: bool = False) -> Result:
    """Runs the last step. debug adds each other step's row count and first five rows, at the cost of a job for each."""
    built, issues, steps = fold(plan, catalog)
    if issues or not steps:
        raise PlanError(issues or [Issue("plan.steps_empty", "the plan was refused")])
    last, p = built[steps[-1]["id"]], steps[-1]["params"]
    most = row_cap(p.get("max_rows"))
    rows = last.limit(most + 1).collect()
    total = last.count() if len(rows) > most else len(rows)
    samples = {s["id"]: (built[s["id"]].count(), built[s["id"]].limit(5).collect()) for s in steps[:-1]} if debug else {}
    return Result(last.columns, rows[:most], total, total > most, p.get("format", "table"), p.get("title"), samples)
