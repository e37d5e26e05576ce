"""All queries of the library proper."""

from flowlens.plans import event_queries, report_queries  # noqa: F401  they register their queries
from flowlens.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
