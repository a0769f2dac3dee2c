"""Imports every registration."""

from registry import cataloging, finding, linking, modelling, profiling, quality, resolving  # noqa: F401
from registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
