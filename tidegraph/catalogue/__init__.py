"""One named query per operator over the supplied tables, each with the same query in plain SQL."""

from . import graphs, logs, models, synthetic  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
