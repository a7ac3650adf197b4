"""Every registered query by name: a function of the star tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.sources.star import AS_OF, Star

QUERIES: dict[str, Callable[[Star], DataFrame]] = {}

PATIENT = "Customer#000000025"
DEPARTMENT = "Emergency Department"


def register(name: str, build: Callable[[Star], DataFrame]) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = build


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from wardline.plans import catalog, catalog_care  # noqa: F401 - fill QUERIES

    def bind(build):
        return lambda spark, sf_dir: build(Star(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}


__all__ = ["AS_OF", "DEPARTMENT", "PATIENT", "QUERIES", "callables", "register"]
