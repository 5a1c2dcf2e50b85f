"""Rules for plans and steps. Schemas come from the DataFrames themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..catalog import CONTRACTS, NAME, family
from ..operators import AGGREGATES, CONDITIONS, JOINS, OPERATIONS
from .recipes import RECIPES

# What plans may say.
VERSION = "v2"
ORDERS, FORMATS, MOST_ROWS = ("asc", "desc"), ("table", "chart", "json"), 10_000
REASONS = ("out_of_dataset_scope", "unsupported_skill", "missing_data_or_artifact", "clarification_required")
NEEDS = {
    "filter": ("input", "column", "operator"),
    "join": ("left", "right", "on"),
    "aggregate": ("input", "group_by", "metrics"),
    "compare": ("left", "right", "join_key", "left_label", "right_label"),
    "calculate": ("input", "expressions"),
    "sort": ("input", "by"),
    "present": ("input",),
}
OPERANDS = {
    "add": ("left", "right"),
    "subtract": ("left", "right"),
    "multiply": ("left", "right"),
    "divide": ("left", "right"),
    "percent_change": ("base", "current"),
    "ratio": ("numerator", "denominator"),
    "share_of_total": ("value",),
}


@dataclass(frozen=True)
class Issue:
    code: str
    message: str
    step: str | None = None


def plan_issues(plan: Any) -> Iterator[Issue]:
    """The plan as a whole: version, steps, ids, skills. A refused plan (answerable false) has a reason, a message and no steps."""
    if not isinstance(plan, Mapping):
        yield Issue("plan.not_object", "a plan is an object")
        return
    if plan.get("answerable") is False:
        if plan.get("reason") not in REASONS:
            yield Issue("plan.reason_invalid", f"reason must be one of {', '.join(REASONS)}")
        if not str(plan.get("message") or "").strip():
            yield Issue("plan.reject_message_required", "a refusal needs a message")
        if plan.get("steps"):
            yield Issue("plan.reject_steps_not_empty", "a refusal has no steps")
        if plan.get("capability_gap") is not None and not isinstance(plan["capability_gap"], Mapping):
            yield Issue("plan.capability_gap_not_object", "capability_gap is an object")
        return
    if plan.get("plan_version") != VERSION:
        yield Issue("plan.version_mismatch", f"plan_version must be {VERSION}")
    steps = plan.get("steps")
    if not isinstance(steps, list):
        yield Issue("plan.steps_not_list", "steps is a list")
        return
    if not steps:
        yield Issue("plan.steps_empty", "a plan needs steps")
    seen: set[str] = set()
    for step in steps:
        if not isinstance(step, Mapping):
            yield Issue("step.not_object", "a step is an object")
            continue
        name, skill = step.get("id"), step.get("skill")
        shown = str(name)
        if not name or not isinstance(name, str):
            yield Issue("step.id_missing", "a step needs an id")
        elif not NAME.fullmatch(name):
            yield Issue("step.id_invalid", "an id has letters, digits and underscores", shown)
        elif name in CONTRACTS:
            yield Issue("step.id_reserved", "the id is a table's name", shown)
        elif name in seen:
            yield Issue("step.id_duplicated", "the id occurs before", shown)
        seen.add(shown)
        if not skill:
            yield Issue("step.skill_missing", "a step needs a skill", shown)
        elif skill not in NEEDS and skill not in RECIPES:
            yield Issue("step.skill_unknown", f"no skill {skill!r}", shown)
        if not isinstance(step.get("params"), Mapping):
            yield Issue("step.params_not_object", "params is an object", shown)


def reference_issues(step: Mapping[str, Any], known: Callable[[str], bool], later: set[str]) -> Iterator[Issue]:
    """Missing parameters, and inputs that are neither tables nor earlier steps."""
    params, name = step["params"], step["id"]
    lacking = [k for k in NEEDS[step["skill"]] if k not in params]
    if lacking:
        yield Issue("params.missing_keys", f"missing: {', '.join(lacking)}", name)
    for key in ("input", "left", "right"):
        if key in NEEDS[step["skill"]] and key in params:
            ref = params[key]
            if not isinstance(ref, str) or not ref.strip():
                yield Issue("params.input_missing", f"{key} must name a table or step", name)
            elif not known(ref):
                yield Issue("params.input_forward_ref" if ref in later else "params.input_unknown", f"{key}: {ref!r} is no table or earlier step", name)


def unknown(df: DataFrame, columns: Any, code: str, name: str) -> Iterator[Issue]:
    for c in columns:
        if c not in df.columns:
            yield Issue(code, f"no column {c!r}", name)


def is_names(value: Any) -> bool:
    return isinstance(value, list) and all(isinstance(v, str) and v for v in value)


def filter_issues(name: str, p: Mapping[str, Any], df: DataFrame) -> Iterator[Issue]:
    yield from unknown(df, [p["column"]], "params.column_unknown", name)
    how, value = p["operator"], p.get("value")
    if how not in CONDITIONS:
        yield Issue("params.operator_invalid", f"no operator {how!r}", name)
        return
    if how in ("is_null", "not_null"):
        if value is not None:
            yield Issue("params.value_unexpected", f"{how} takes no value", name)
        return
    many = how in ("in", "not_in", "between")
    if many and (not isinstance(value, list) or not value):
        yield Issue("params.value_not_list", f"{how} takes a list", name)
        return
    if how == "between" and len(value) != 2:
        yield Issue("params.value_between_arity", "between takes two values", name)
    if p["column"] in df.columns:
        kind = family(df.schema[p["column"]].dataType)
        values = value if many else [value]
        fits = {"numeric": (int, float), "time": (str,), "text": (str,), "boolean": (bool,)}.get(kind)
        wrong = fits and any(v is not None and (not isinstance(v, fits) or (isinstance(v, bool) and kind != "boolean")) for v in values)
        if wrong or (how == "contains" and kind != "text"):
            yield Issue("params.value_type_mismatch", f"the value doesn't suit a {kind} column", name)


def join_issues(name: str, p: Mapping[str, Any], left: DataFrame, right: DataFrame) -> Iterator[Issue]:
    if not isinstance(p["on"], list) or not p["on"]:
        yield Issue("params.on_not_list", "on is a list", name)
    elif not is_names(p["on"]):
        yield Issue("params.on_not_string_list", "on has column names", name)
    else:
        for side in (left, right):
            yield from unknown(side, p["on"], "params.join_key_unknown", name)
    if p.get("how", "inner") not in JOINS:
        yield Issue("params.how_invalid", f"how is one of {', '.join(JOINS)}", name)


def aggregate_issues(name: str, p: Mapping[str, Any], df: DataFrame) -> Iterator[Issue]:
    if not is_names(p["group_by"]):
        yield Issue("params.group_by_not_list", "group_by has column names", name)
        return
    yield from unknown(df, p["group_by"], "params.column_unknown", name)
    if not isinstance(p["metrics"], list) or not p["metrics"]:
        yield Issue("params.metrics_not_list", "metrics is a list", name)
        return
    seen: set[str] = set()
    for m in p["metrics"]:
        if not isinstance(m, Mapping):
            yield Issue("params.metric_not_object", "a metric is an object", name)
            continue
        called, function, column = m.get("name"), m.get("function"), m.get("column")
        if not isinstance(called, str) or not called:
            yield Issue("params.metric_name_missing", "a metric needs a name", name)
        elif called in seen:
            yield Issue("params.metric_name_duplicated", f"{called!r} occurs twice", name)
        elif called in p["group_by"]:
            yield Issue("params.metric_name_collides_group_by", f"{called!r} is a group column", name)
        elif called.startswith(("a_", "b_", "left_", "right_")):
            yield Issue("params.metric_name_label_prefix", f"{called!r} looks like a compared column", name)
        seen.add(str(called))
        if function not in AGGREGATES:
            yield Issue("params.metric_function_invalid", f"no aggregate {function!r}", name)
        elif column in (None, "", "*"):
            if function != "count":
                yield Issue("params.metric_column_missing", f"{function} needs a column", name)
        elif column not in df.columns:
            yield Issue("params.column_unknown", f"no column {column!r}", name)
        else:
            kind = family(df.schema[column].dataType)
            if function in ("sum", "avg") and kind != "numeric":
                yield Issue("params.metric_column_not_numeric", f"{function} of a {kind} column", name)
            if function in ("min", "max") and kind == "other":
                yield Issue("params.metric_column_not_orderable", f"{function} of {column!r}", name)


def compare_issues(name: str, p: Mapping[str, Any], left: DataFrame, right: DataFrame, scalar: Callable[[str], bool]) -> Iterator[Issue]:
    if not isinstance(p["join_key"], list):
        yield Issue("params.join_key_not_list", "join_key is a list", name)
    elif not p["join_key"]:
        if not (scalar(p["left"]) and scalar(p["right"])):
            yield Issue("params.join_key_empty_not_scalar", "without keys both sides must be totals", name)
    else:
        for side in (left, right):
            yield from unknown(side, p["join_key"], "params.compare_join_key_unknown", name)
    for key in ("left_label", "right_label"):
        if not isinstance(p[key], str) or not p[key]:
            yield Issue(f"params.{key}_missing", f"{key} is a name", name)
        elif not NAME.fullmatch(p[key]):
            yield Issue(f"params.{key}_unsafe", f"{key} has letters, digits and underscores", name)
    if p["left_label"] == p["right_label"]:
        yield Issue("params.compare_labels_identical", "labels must differ", name)


def calculate_issues(name: str, p: Mapping[str, Any], df: DataFrame) -> Iterator[Issue]:
    if not isinstance(p["expressions"], list) or not p["expressions"]:
        yield Issue("params.expressions_not_list", "expressions is a list", name)
        return
    seen = set(df.columns)
    for e in p["expressions"]:
        if not isinstance(e, Mapping):
            yield Issue("params.expression_not_object", "an expression is an object", name)
            continue
        if not isinstance(e.get("name"), str) or not e["name"]:
            yield Issue("params.expression_name_missing", "an expression needs a name", name)
        elif e["name"] in seen:
            yield Issue("params.expression_name_duplicated", f"{e['name']!r} exists", name)
        seen.add(str(e.get("name")))
        op = e.get("operation")
        if op not in OPERATIONS:
            yield Issue("params.expression_operation_invalid", f"no operation {op!r}", name)
            continue
        keys = OPERANDS[op] if op != "ratio" or "left" not in e else ("left", "right")
        lacking = [k for k in keys if not isinstance(e.get(k), str)]
        if lacking:
            yield Issue("params.expression_keys_missing", f"missing: {', '.join(lacking)}", name)
        for k in keys:
            if isinstance(e.get(k), str):
                if e[k] not in df.columns:
                    yield Issue("params.expression_column_unknown", f"no column {e[k]!r}", name)
                elif family(df.schema[e[k]].dataType) != "numeric":
                    yield Issue("params.expression_column_not_numeric", f"{e[k]!r} is not numeric", name)
        parts = e.get("partition_by")
        if parts is not None:
            if not is_names(parts):
                yield Issue("params.expression_partition_by_not_list", "partition_by has column names", name)
            else:
                yield from unknown(df, parts, "params.expression_column_unknown", name)


def sort_issues(name: str, p: Mapping[str, Any], df: DataFrame) -> Iterator[Issue]:
    if not is_names(p["by"]) or not p["by"]:
        yield Issue("params.by_not_list", "by has column names", name)
    else:
        yield from unknown(df, p["by"], "params.sort_by_unknown", name)
    if p.get("order", "desc") not in ORDERS:
        yield Issue("params.order_invalid", "order is asc or desc", name)
    limit = p.get("limit")
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 1):
        yield Issue("params.limit_invalid", "limit is a positive number", name)
    elif limit is not None and limit > MOST_ROWS:
        yield Issue("params.limit_cap_exceeded", f"limit is at most {MOST_ROWS}", name)


def present_issues(name: str, p: Mapping[str, Any], df: DataFrame) -> Iterator[Issue]:
    if p.get("format", "table") not in FORMATS:
        yield Issue("params.format_invalid", f"format is one of {', '.join(FORMATS)}", name)
    columns = p.get("columns")
    if columns is not None:
        if not isinstance(columns, list):
            yield Issue("params.columns_not_list", "columns is a list", name)
        elif not is_names(columns):
            yield Issue("params.columns_invalid", "columns has column names", name)
        else:
            yield from unknown(df, columns, "params.columns_unknown", name)
    rows = p.get("max_rows")
    if rows is not None and (not isinstance(rows, int) or isinstance(rows, bool) or rows < 1):
        yield Issue("params.limit_invalid", "max_rows is a positive number", name)
    elif rows is not None and rows > MOST_ROWS:
        yield Issue("params.limit_cap_exceeded", f"max_rows is at most {MOST_ROWS}", name)
