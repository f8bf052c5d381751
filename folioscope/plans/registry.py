"""All queries of the library, and the SQL that each is checked against."""

from __future__ import annotations

import importlib

MODULES = ("packed_queries", "retrieval_queries", "segment_queries", "cell_queries", "check_queries", "bibliography_queries", "report_queries", "manuscript_queries", "stream_queries", "fixture_queries")


def collected(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"folioscope.plans.{name}"), kind).items():
            if key in found:
                raise ValueError(f"two queries are named {key}")
            found[key] = value
    return found
