"""Query registry: each module gives QUERIES (Spark) and ORACLE (DuckDB SQL for the same rows)."""

from __future__ import annotations

import importlib

MODULES = ["flow_queries", "label_queries", "feature_queries", "threshold_queries", "join_queries", "evaluation_queries", "report_queries", "model_queries", "stream_queries", "source_queries"]


def collect(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(importlib.import_module(f"wirefold.registry.{m}"), attr)
        dup = set(part) & set(out)
        if dup:
            raise ValueError(f"duplicate query names: {sorted(dup)}")
        out.update(part)
    return out
