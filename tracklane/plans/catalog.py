"""All queries of the sensor-fusion operators."""

from . import files, queries, roundtrips  # noqa: F401  register them
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
