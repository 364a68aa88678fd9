"""Queries by name, and the DuckDB SQL of each."""

from __future__ import annotations

from sondage.plans import admission, appending, blocking, edges, endpoints, evidence, feeds, inventory, ledger, logs, mapping, series, topology, traces
from sondage.plans.base import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (series, logs, traces, inventory, evidence, blocking, endpoints, edges, ledger, feeds, topology, mapping, appending, admission):
    QUERIES |= module.PLANS.queries
    ORACLE_SQL |= module.PLANS.sql
