"""Recipes: steps that stand for several atomic steps. Their expansion is fixed by their parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, timedelta
from typing import Any

Step = dict[str, Any]

# Names that filters in recipes may use for the atomic operators.
FILTER_NAMES = {
    "=": "eq",
    "==": "eq",
    "eq": "eq",
    "!=": "neq",
    "neq": "neq",
    ">": "gt",
    "gt": "gt",
    ">=": "gte",
    "gte": "gte",
    "<": "lt",
    "lt": "lt",
    "<=": "lte",
    "lte": "lte",
    "in": "in",
    "not_in": "not_in",
    "contains": "contains",
}
MOST_SAMPLES = 100


class RecipeError(ValueError):
    """A recipe's parameters don't allow an expansion. code names the failed rule."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Chain:
    """Atomic steps under construction; each id is the recipe's id and a suffix."""

    def __init__(self, step: Mapping[str, Any]):
        self.base = str(step.get("id") or step["skill"])
        self.params = dict(step.get("params") or {})
        self.steps: list[Step] = []
        if not isinstance(self.params.get("input"), str) or not self.params["input"].strip():
            raise RecipeError("input_missing", f"{step['skill']} needs an input")
        if self.params.get("metric", "count") != "count":
            raise RecipeError("recipe_metric_unsupported", "the only metric is count")
        if self.params.get("title") is not None and not isinstance(self.params["title"], str):
            raise RecipeError("recipe_title_invalid", "title must be a string")

    def add(self, suffix: str, skill: str, **params: Any) -> str:
        self.steps.append({"id": f"{self.base}_{suffix}", "skill": skill, "params": params})
        return self.steps[-1]["id"]

    def count(self, suffix: str, source: str, group_by: list[str], name: str = "count") -> str:
        return self.add(suffix, "aggregate", input=source, group_by=list(group_by), metrics=[{"name": name, "function": "count", "column": "*"}])

    def show(self, source: str, columns: list[str]) -> list[Step]:
        title = (self.params.get("title") or "").strip()
        self.add("present", "present", input=source, format="table", columns=columns, **({"title": title} if title else {}))
        return self.steps

    def names(self, key: str, *, needed: bool = True) -> list[str]:
        found = self.params.get(key)
        if found in (None, []) and not needed:
            return []
        if not isinstance(found, list) or not found or not all(isinstance(c, str) and c.strip() for c in found):
            raise RecipeError("recipe_columns_invalid" if key == "columns" else "recipe_group_by_invalid", f"{key} must be a list of column names")
        return [c.strip() for c in found]

    def name(self, key: str, default: str, code: str = "recipe_column_name_invalid") -> str:
        found = self.params.get(key, default)
        if not isinstance(found, str) or not found.strip():
            raise RecipeError(code, f"{key} must be a column name")
        return found.strip()

    def number(self, key: str, default: int, least: int, most: int | None = None, code: str = "recipe_window_invalid") -> int:
        found = self.params.get(key, default)
        if not isinstance(found, int) or isinstance(found, bool) or found < least or (most is not None and found > most):
            raise RecipeError(code, f"{key} must be a whole number from {least}" + (f" to {most}" if most else ""))
        return found

    def period(self, key: str) -> list[str]:
        found = self.params.get(key)
        try:
            start, end = (date.fromisoformat(found[k]) for k in ("start", "end"))
        except (TypeError, KeyError, ValueError) as e:
            raise RecipeError("recipe_period_invalid", f"{key} must have ISO dates start and end") from e
        if start > end:
            raise RecipeError("recipe_period_invalid", f"{key} ends before it starts")
        return [start.isoformat(), end.isoformat()]

    def filtered(self, source: str) -> str:
        filters = self.params.get("filters") or []
        if not isinstance(filters, list):
            raise RecipeError("recipe_filter_invalid", "filters must be a list")
        for k, f in enumerate(filters):
            how = FILTER_NAMES.get(str(f.get("op", "")).strip()) if isinstance(f, Mapping) else None
            if how is None or not isinstance(f.get("column"), str):
                raise RecipeError("recipe_filter_invalid", "a filter needs a column and a known op")
            if "value" not in f or (how in ("in", "not_in")) != isinstance(f["value"], list) or f["value"] == []:
                raise RecipeError("recipe_filter_value_invalid", f"the value doesn't suit {f['op']}")
            source = self.add(f"filter_{k}", "filter", input=source, column=f["column"], operator=how, value=f["value"])
        return source


def distribution(step: Mapping[str, Any]) -> list[Step]:
    """Counts by group, with their shares of the whole."""
    c = Chain(step)
    groups, count, share = c.names("group_by"), c.name("count_column", "count"), c.name("share_column", "ratio")
    wanted = c.params.get("include_share", True)
    if not isinstance(wanted, bool):
        raise RecipeError("recipe_include_share_invalid", "include_share must be true or false")
    last = c.count("agg", c.params["input"], groups, count)
    if wanted:
        last = c.add("share", "calculate", input=last, expressions=[{"name": share, "operation": "share_of_total", "value": count}])
    return c.show(last, [*groups, count, *([share] if wanted else [])])


def event_window_count(step: Mapping[str, Any]) -> list[Step]:
    """Counts by date from some days before an event to some days after it, the last day whole. The date column is grouped as it is."""
    c = Chain(step)
    column, count = c.name("date_column", "created_at", "recipe_date_column_invalid"), c.name("count_column", "count")
    if c.params.get("grain", "day") != "day":
        raise RecipeError("recipe_grain_unsupported", "the only grain is day")
    try:
        event = date.fromisoformat(c.params["event_date"])
    except (KeyError, TypeError, ValueError) as e:
        raise RecipeError("recipe_event_date_invalid", "event_date must be an ISO date") from e
    if count == column:
        raise RecipeError("recipe_column_name_invalid", "count_column and date_column must differ")
    first = event - timedelta(days=c.number("before_days", 7, 0))
    past = event + timedelta(days=c.number("after_days", 7, 0) + 1)
    last = c.add("from", "filter", input=c.params["input"], column=column, operator="gte", value=first.isoformat())
    last = c.add("window", "filter", input=last, column=column, operator="lt", value=past.isoformat())
    last = c.add("sorted", "sort", input=c.count("by_date", last, [column], count), by=[column], order="asc")
    return c.show(last, [column, count])


def top_n(step: Mapping[str, Any]) -> list[Step]:
    """The groups with the most (or least) rows. Ties at the cut are broken by the group columns."""
    c = Chain(step)
    groups, limit, count = c.names("group_by"), c.number("limit", 10, 1, code="recipe_limit_invalid"), c.name("count_column", "count")
    by = c.params.get("sort") or {}
    if not isinstance(by, Mapping) or by.get("direction", "desc") not in ("asc", "desc") or by.get("column", count) not in [*groups, count]:
        raise RecipeError("recipe_sort_invalid", "sort needs a group column or the count, and a direction")
    last = c.count("agg", c.filtered(c.params["input"]), groups, count)
    keys = [by.get("column", count), *[g for g in groups if g != by.get("column", count)]]
    last = c.add("sorted", "sort", input=last, by=keys, order=by.get("direction", "desc"), limit=limit)
    return c.show(last, [*groups, count])


def sample_rows(step: Mapping[str, Any]) -> list[Step]:
    """The first rows by a sort that the parameters fix; not a random sample."""
    c = Chain(step)
    columns, limit = c.names("columns"), c.number("limit", 10, 1, MOST_SAMPLES, "recipe_limit_invalid")
    by = c.params.get("sort") or {}
    if not isinstance(by, Mapping) or by.get("direction", "asc") not in ("asc", "desc"):
        raise RecipeError("recipe_sort_invalid", "sort needs columns and a direction")
    keys = by.get("by") or list(dict.fromkeys(["doc_id", *columns] if c.params.get("doc_key", True) else columns))
    last = c.add("sorted", "sort", input=c.filtered(c.params["input"]), by=[keys] if isinstance(keys, str) else list(keys), order=by.get("direction", "asc"), limit=limit)
    return c.show(last, columns)


def _periods(step: Mapping[str, Any], *, shares: bool) -> list[Step]:
    c = Chain(step)
    column, groups = c.name("date_column", "created_at", "recipe_date_column_invalid"), c.names("group_by", needed=shares)
    ends = {}
    for label in ("a", "b"):
        cut = c.add(f"{label}_window", "filter", input=c.params["input"], column=column, operator="between", value=c.period(f"period_{label}"))
        ends[label] = c.count(f"{label}_agg", cut, groups)
        if shares:
            ends[label] = c.add(f"{label}_share", "calculate", input=ends[label], expressions=[{"name": "ratio", "operation": "share_of_total", "value": "count"}])
    both = c.add("compare", "compare", left=ends["a"], right=ends["b"], join_key=list(groups), left_label="a", right_label="b")
    change = [{"name": "delta_count", "operation": "subtract", "left": "b_count", "right": "a_count"}]
    if shares:
        change.append({"name": "delta_ratio", "operation": "subtract", "left": "b_ratio", "right": "a_ratio"})
        columns = ["a_count", "a_ratio", "b_count", "b_ratio", "delta_count", "delta_ratio"]
    else:
        change.append({"name": "delta_rate", "operation": "percent_change", "base": "a_count", "current": "b_count"})
        columns = ["a_count", "b_count", "delta_count", "delta_rate"]
    return c.show(c.add("delta", "calculate", input=both, expressions=change), [*groups, *columns])


def period_compare_count(step: Mapping[str, Any]) -> list[Step]:
    """Counts in two periods, in all or by group, with difference and percent change. A bare end date excludes times on that day."""
    return _periods(step, shares=False)


def period_compare_distribution(step: Mapping[str, Any]) -> list[Step]:
    """Counts and shares by group in two periods, with their differences."""
    return _periods(step, shares=True)


RECIPES: dict[str, Callable[[Mapping[str, Any]], list[Step]]] = {
    f.__name__: f for f in (distribution, event_window_count, top_n, sample_rows, period_compare_count, period_compare_distribution)
}


def expand(steps: list[Mapping[str, Any]]) -> list[Step]:
    """Atomic steps only. A reference to a recipe's id means its last step."""
    out: list[Step] = []
    ends: dict[str, str] = {}
    for step in steps:
        params = {k: ends.get(v, v) if k in ("input", "left", "right") and isinstance(v, str) else v for k, v in (step.get("params") or {}).items()}
        step = {**step, "params": params}
        if step["skill"] in RECIPES:
            made = RECIPES[step["skill"]](step)
            ends[str(step["id"])] = made[-1]["id"]
            out += made
        else:
            out.append(step)
    return out
