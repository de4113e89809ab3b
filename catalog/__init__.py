"""The registered queries: each runs an operator on the given tables.

Beside each query stands SQL that computes the same result another way, for
checking on an independent engine.
"""

from catalog import cleaning, labels, merging, missing, outliers, profiling  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
