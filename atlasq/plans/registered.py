"""All registered queries with their SQL."""

from __future__ import annotations

from . import catalog_files, catalog_paths, catalog_planes, catalog_rasters  # noqa: F401  (their queries register themselves)
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
