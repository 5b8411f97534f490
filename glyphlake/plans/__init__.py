"""All queries that the engine registers, and their SQL."""

from . import search_queries, set_queries, upkeep_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
