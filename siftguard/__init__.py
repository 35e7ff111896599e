"""Security analytics for code, configuration and text, expressed as Spark DataFrames."""

from .config import ScanConfig, load_config
from .rules import Rule, builtin_rules, select_rules

__all__ = ["Rule", "ScanConfig", "builtin_rules", "load_config", "select_rules"]
