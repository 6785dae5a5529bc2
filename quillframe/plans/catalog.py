"""All registered queries."""

from __future__ import annotations

from quillframe.plans import ingest, language, pixels, reading, training  # noqa: F401
from quillframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
