"""All registered queries."""

from foldwright.catalog.base import ORACLES, QUERIES
from foldwright.catalog import (  # noqa: F401
    comparisons,
    data,
    models,
    preparation,
    scores,
    splits,
    storage,
    streams,
    study,
)

__all__ = ["ORACLES", "QUERIES"]
