"""All registered queries."""

from duploscope.plans import folders, imaging, removing, reviewing, scanning  # noqa: F401
from duploscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
