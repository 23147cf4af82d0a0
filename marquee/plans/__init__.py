"""Registered queries over the driver's tables, with their SQL."""

from marquee.plans import checks, imports, listings, review
from marquee.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checks", "imports", "listings", "review"]
