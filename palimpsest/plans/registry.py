"""All queries of the library's own operators."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLE, QUERIES

for _m in ("documents", "collection", "eras", "chats", "pieces", "scores", "flows", "reply_queries", "record_queries", "selections", "run_queries"):
    import_module(f"{__package__}.{_m}")

__all__ = ["ORACLE", "QUERIES"]
