"""All registered queries of the engine with their DuckDB twins."""

from __future__ import annotations

from . import aggregates, decisions, evaluation, metric_registry, metrics, reads, replays, scoring, sequences, signals, stats, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
