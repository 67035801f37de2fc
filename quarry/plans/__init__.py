"""Registered queries over the supplied tables and the SQL they are held against."""

from quarry.plans.relational import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
