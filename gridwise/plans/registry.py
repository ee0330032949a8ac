"""All registered queries with their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwise.plans import catalogs, composed, datasets, elements, evaluation, lattice, polygons, radar, rasters, runs, sampling, spatials
from gridwise.plans.base import Entry

FLAGSHIP = "nearest_line_prior_rank"
_ALL: dict[str, Entry] = {name: e for m in (lattice, spatials, polygons, evaluation, datasets, sampling, rasters, radar, elements, composed, catalogs, runs) for name, e in m.ENTRIES.items()}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: e.query for name, e in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: e.sql for name, e in _ALL.items() if e.sql}
