"""All queries: importing the modules registers them."""

from tessella.plans import display, planning, raster, requests, streams, texts  # noqa: F401
from tessella.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
