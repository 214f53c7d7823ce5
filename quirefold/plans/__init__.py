"""Ready-made queries over the test tables, by name."""

from __future__ import annotations

from quirefold.plans import audit, calibration, data_care, graph, reading, relations, texts, timelines

_MODULES = (data_care, texts, relations, graph, calibration, reading, audit, timelines)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
