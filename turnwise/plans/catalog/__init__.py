"""Named queries over the analytics tables, each with the SQL that must give the same rows where SQL can say it."""

from turnwise.plans.catalog.registry import ORACLES, QUERIES
from turnwise.plans.catalog import conversation, ingest, linking, reading, records, shapes, sources, usage  # noqa: F401 - registers

__all__ = ["ORACLES", "QUERIES"]
