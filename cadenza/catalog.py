"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from cadenza.plans import assets, evidence, folds, gates, streams

_MODULES = (streams, assets, evidence, folds, gates)
QUERIES = {name: query for m in _MODULES for name, query in m.Q.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.S.items()}
