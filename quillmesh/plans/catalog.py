"""All queries over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from quillmesh.plans import code, retrieval

_MODULES = (retrieval, code)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
