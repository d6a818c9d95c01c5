"""All named queries of the engine."""

from __future__ import annotations

from tidemark.plans import answers, content, history, lifecycle, performance, review, streams

MODULES = (performance, content, lifecycle, review, history, streams, answers)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
