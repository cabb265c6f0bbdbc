"""All queries of the engine and their SQL."""

from __future__ import annotations

from cairn.plans import base


def _load() -> None:
    from cairn.plans import connectors, groups, measurements, neighbours  # noqa: F401


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql():
    _load()
    return dict(base.SQL)
