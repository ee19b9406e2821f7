"""The queries of the engine by name, and their SQL."""

from graphloom.plans.oracle import ORACLES
from graphloom.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
