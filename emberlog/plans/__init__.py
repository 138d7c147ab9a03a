"""The registered queries and the same in DuckDB's SQL."""

from . import detectors, reports, review, streams
from .oracles import ORACLES
from .queries import FLAGSHIP, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "detectors", "reports", "review", "streams"]
