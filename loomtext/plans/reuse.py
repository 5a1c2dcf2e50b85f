"""Small changes to an earlier plan: another format, or a limit, without planning anew."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from typing import Any

from .checks import FORMATS, MOST_ROWS


def patch(plan: Mapping[str, Any], *, format: str | None = None, limit: int | None = None) -> dict[str, Any] | None:
    """The plan with its last step's format changed, or its last sort before it limited; None where that can't be done."""
    out = deepcopy(dict(plan))
    steps = out.get("steps") or []
    if out.get("answerable") is False or not steps or steps[-1].get("skill") != "present":
        return None
    if format is not None:
        if format not in FORMATS:
            return None
        steps[-1]["params"]["format"] = format
    if limit is not None:
        shown = steps[-1]["params"].get("input")
        before = next((s for s in steps if s.get("id") == shown), None)
        if not before or before.get("skill") != "sort" or isinstance(limit, bool) or not 1 <= limit <= MOST_ROWS:
            return None
        before["params"]["limit"] = limit
    return out


def display(steps: list[Mapping[str, Any]]) -> list[str]:
    """A line for each step, for people."""
    return [f"{s['id']} = {s['skill']}({', '.join(f'{k}={v!r}' for k, v in s['params'].items())})" for s in steps]
