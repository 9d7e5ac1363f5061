"""Queries over the given tables, each with the SQL that gives the same result."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import q_tables, q_profile, q_prepare, q_merge, q_charts, q_plans  # noqa: F401, E402
