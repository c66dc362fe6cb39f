"""All checked queries."""

from . import checks_analysis, checks_charts, checks_models, checks_tables
from .registry import PLAIN, QUERIES, SQL

__all__ = ["PLAIN", "QUERIES", "SQL", "checks_analysis", "checks_charts", "checks_models", "checks_tables"]
