"""All registered queries."""

from catalog import accuracy, lane_choice, motion, poses_store, shapes  # noqa: F401
from catalog.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
