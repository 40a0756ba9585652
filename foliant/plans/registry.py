"""The queries of this library by name, and the DuckDB SQL each is held against."""

from __future__ import annotations

from . import geometry, pages, quality, selection, text

MODULES = [quality, geometry, text, selection, pages]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
