"""Registered queries of the scene engine: each is an operator over whole derived tables, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequarry.plans.views import stream_view, view, with_views

#: Coordinates of the derived cloud have at most seven places, so that rounding to seven never meets a tie.
PLACES = 7


@dataclass
class Registry:
    """Queries by name. Columns named in ``doubles`` are rounded alike on both sides."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None, doubles: str = "", places: int = PLACES):
        """Register the decorated ``function(get)``; ``get(view)`` gives a derived table, with ``stream=True`` as a stream, with ``spread=False`` as its files are."""
        names = doubles.split()

        def keep(function: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                out = function(lambda table, stream=False, spread=True: stream_view(spark, sf_dir, table) if stream else view(spark, sf_dir, table, spread))
                # Adding 0.0 makes a negative zero positive.
                return out.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in names})

            self.queries[name] = run
            if sql is not None:
                body = with_views(sql)
                self.sql[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {places}) + 0.0 AS {c}' for c in names)}) FROM ({body})" if names else body
            return function

        return keep


REGISTRY = Registry()
_MODULES = ("cloud_queries", "camera_queries", "object_queries", "trace_queries", "lift_queries", "table_queries", "stream_queries", "source_queries")


def _loaded() -> Registry:
    for m in _MODULES:
        import_module(f"scenequarry.plans.{m}")
    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_loaded().queries)


def voxel_thinning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return queries()["w1_voxel_thinning_counts"](spark, sf_dir)
