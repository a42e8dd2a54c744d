"""All registered queries."""

from fieldpulse.plans.catalog import jobs, joins, ordered, reports, scans, streams  # noqa: F401  (they register themselves)
from fieldpulse.plans.catalog.registry import QUERIES

__all__ = ["QUERIES"]
