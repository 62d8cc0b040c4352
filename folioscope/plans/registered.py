"""Imports every module that registers queries."""

from . import q_groups, q_ingest, q_scalar, q_search, q_serve, q_sql, q_state  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
