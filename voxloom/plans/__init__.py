"""Queries of the library; importing the modules registers them."""

from voxloom.plans import engines, files, library, prompts, speech, text  # noqa: F401
from voxloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
