"""Named query plans over the operators."""

from loadlens.plans import aggregates, symbols, transforms
from loadlens.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "symbols", "transforms"]
