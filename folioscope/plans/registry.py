"""Registration of queries with the inventory IDs they show and their SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables, with_derived


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, root: str) -> DataFrame:
        return self.build(Tables(spark, root))


CATALOG: dict[str, Query] = {}


def query(ids: str, oracle: str | None = None) -> Callable:
    """Register the decorated builder under its own name."""
    def keep(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        if name in CATALOG:
            raise ValueError(f"registered twice: {name}")
        CATALOG[name] = Query(name, tuple(ids.split()), build, with_derived(oracle) if oracle else None)
        return build
    return keep


def catalog() -> dict[str, Query]:
    """Every registered query; the families register on import."""
    from . import corpus_queries, graph_queries, intake_queries, io_queries, quality_queries, search_queries, state_queries, stream_queries  # noqa: F401
    return CATALOG
