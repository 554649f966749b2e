"""Every registered query of the library with its SQL twin."""

from __future__ import annotations

from castline import registry
from castline.plans import slice as monthly
from castline.queries import accounting, aggregates, batch, ingest, matching, phrases, plans, retrieval, scalars, selection, series, sets, sources, streams, windows  # noqa: F401  they register themselves


def queries():
    return monthly.QUERIES | registry.QUERIES


def oracle_sql():
    return monthly.SQL | registry.SQL
