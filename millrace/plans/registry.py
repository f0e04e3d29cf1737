"""Queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from . import attempts, lineage, orders, packs, patches, preferences, records, reviews, scans, sequences, transforms, trees

FLAGSHIP = "review_gate_counts"
QUERIES, SQL = {}, {}
for part in (reviews, sequences, orders, transforms, attempts, preferences, records, packs, scans, lineage, patches, trees):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
