"""All queries of the library and their SQL."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("text", "elements", "store", "retrieval", "ranking", "evaluation", "domain", "files", "reports", "requests", "evaluator", "layout", "search", "models"):
    import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
