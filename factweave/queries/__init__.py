"""The registered queries over the supplied tables, and their SQL."""

from .registry import ORACLES, QUERIES
from . import aggregates, filters, flagship as _flagship, graphs, joins, projections, quality, scoring, sets, sources, streams, texts, windows  # noqa: F401  (each registers its queries)

flagship = QUERIES["flagship"]

__all__ = ["ORACLES", "QUERIES", "flagship"]
