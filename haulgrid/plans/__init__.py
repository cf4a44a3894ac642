"""Registered queries: importing this package fills the registry."""

from haulgrid.plans import queries_designs, queries_districts, queries_kernels  # noqa: F401
from haulgrid.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
