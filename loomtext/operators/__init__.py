"""The atomic operators of plans: functions from DataFrames and parameters to a DataFrame. They are lazy and read no data."""

from .calculate import OPERATIONS, calculate
from .relational import AGGREGATES, JOINS, aggregate, compare, join, present, sort
from .rows import CONDITIONS, condition, filter_rows

__all__ = ["AGGREGATES", "CONDITIONS", "JOINS", "OPERATIONS", "aggregate", "calculate", "compare", "condition", "filter_rows", "join", "present", "sort"]
