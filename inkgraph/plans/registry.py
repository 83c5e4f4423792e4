"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from importlib import import_module

#: Modules of this folder that hold QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = ("graph_queries", "serving_queries", "source_queries", "text_queries", "annotator_queries", "analysis_queries", "matcher_queries", "dataset_queries", "alignment_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        for key, value in getattr(import_module(f"inkgraph.plans.{module}"), name).items():
            if key in out:
                raise ValueError(f"{key} is registered twice")
            out[key] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE_SQL")
