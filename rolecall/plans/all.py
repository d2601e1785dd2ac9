"""All registered queries of the library."""

from . import lifecycle, listing, sources, texts, verdicts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
