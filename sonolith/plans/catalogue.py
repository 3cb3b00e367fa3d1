"""All queries on the role views and their SQL."""

from __future__ import annotations

from . import alignment, evidences, metadata, recordings, records, rules, spectral, streams

_PARTS = (spectral, alignment, records, rules, metadata, streams, recordings, evidences)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
