"""Plans: JSON steps that are checked against real schemas and folded into one lazy DataFrame."""

from .checks import Issue
from .recipes import RECIPES, RecipeError, expand
from .run import PlanError, Result, check_plan, fold, run_plan
from .reuse import patch

__all__ = ["RECIPES", "Issue", "PlanError", "RecipeError", "Result", "check_plan", "expand", "fold", "patch", "run_plan"]
