"""All queries over the driver's tables, by name, with their SQL counterparts."""

from __future__ import annotations

from . import domain, files, graph, match, relational, reports, streams, texts
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "domain", "files", "graph", "match", "relational", "reports", "streams", "texts"]
