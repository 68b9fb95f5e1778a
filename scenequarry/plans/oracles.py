"""SQL twins of the registered queries."""

from __future__ import annotations

from scenequarry.plans import registry


def oracle_sql() -> dict[str, str]:
    registry.queries()
    return dict(registry.REGISTRY.sql)
