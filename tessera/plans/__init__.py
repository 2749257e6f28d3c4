"""Named queries: importing this package fills the registry."""

from . import core, dialect, functions, statements, tables, tpch
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "core", "dialect", "functions", "statements", "tables", "tpch"]
