"""Collects every registered query."""
from . import queries_blast, queries_compliance, queries_models, queries_sources, queries_streams, queries_surfaces  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
