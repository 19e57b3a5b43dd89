"""tabvet: rule-driven table validation compiled to Spark DataFrame plans."""

from tabvet.plans.default_rules import DEFAULT_RULES
from tabvet.plans.rules import RuleError, RuleSet, load_rules
from tabvet.plans.validate import Validated, validate
from tabvet.operators.checks import register_check

__all__ = ["DEFAULT_RULES", "RuleError", "RuleSet", "Validated", "load_rules", "register_check", "validate"]
