"""All registered queries of the grid engine with the SQL that checks them."""

from __future__ import annotations

from . import queries_active, queries_fit, queries_images, queries_tree, queries_volume

_MODULES = (queries_tree, queries_images, queries_fit, queries_volume, queries_active)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
