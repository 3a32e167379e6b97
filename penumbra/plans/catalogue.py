"""All queries over the test tables, with their SQL oracles."""

from __future__ import annotations

from penumbra.plans import directions, extra, intensities, matching, orbits, pairs, pixels, rasters, series, spectra, statistics, templates, texts, tiles  # noqa: F401  they register their queries
from penumbra.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
