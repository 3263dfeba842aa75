"""Registered queries over the driver's tables, and SQL with the same results."""

from . import arrivals, judging, labels, landed, relations, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "arrivals", "judging", "labels", "landed", "relations", "texts"]
