"""All registered queries: importing the modules fills the registry."""

from strandline.plans import alignment, grids, ingest, learners, models, scalars, splits, tracking, windows  # noqa: F401
from strandline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
