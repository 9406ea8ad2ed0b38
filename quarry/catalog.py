"""Registered queries and their SQL, by name."""

from __future__ import annotations

from quarry.operators import callgraph, candidates, compare, evaluation, evidence, exports, history, ingest, ordering, sampling, scalars, scoring, secrets, snapshots, state, taxonomy, usage
from quarry.streaming import events

_MODULES = (compare, history, candidates, scoring, usage, evaluation, ordering, state, evidence, callgraph, exports, ingest, scalars, taxonomy, secrets, sampling, snapshots, events)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
