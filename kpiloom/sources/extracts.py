"""Results kept for reuse: persisted queries, written extracts, fitted models."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from kpiloom.session import fresh_path

TTL_SECONDS = 300.0


class TimedCache:
    """Values by key, rebuilt when older than ``ttl`` seconds."""

    def __init__(self, ttl: float = TTL_SECONDS, on_expire: Callable[[Any], Any] | None = None):
        self._ttl = ttl
        self._on_expire = on_expire
        self._kept: dict[Any, tuple[float, Any]] = {}

    def get(self, key: Any, build: Callable[[], Any]) -> Any:
        now = time.monotonic()
        kept = self._kept.get(key)
        if kept is not None and now - kept[0] <= self._ttl:
            return kept[1]
        if kept is not None and self._on_expire is not None:
            self._on_expire(kept[1])
        value = build()
        self._kept[key] = (time.monotonic(), value)
        return value


_queries = TimedCache(on_expire=lambda df: df.unpersist())
# written stages and models last as long as the application: built once, not timed out
_extracts = TimedCache(ttl=float("inf"))
_models = TimedCache(ttl=float("inf"))


def _app(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def cached_query(spark: SparkSession, key: Any, build: Callable[[], DataFrame]) -> DataFrame:
    """Persist a query result for five minutes under ``key``.

    A lost executor only costs recomputation: the lineage is kept.
    """
    return _queries.get((_app(spark), key), lambda: build().persist())


def written(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back.

    Used between the expensive stages of a pipeline so that later jobs neither
    recompute them nor depend on any one executor staying alive.
    """
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def extract(spark: SparkSession, key: Any, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A written table that several queries of one application read."""
    return _extracts.get((_app(spark), name, key), lambda: written(spark, name, build()))


def fitted(spark: SparkSession, key: Any, build: Callable[[], Any]) -> Any:
    """A fitted model, trained once and then served, as a scoring service would."""
    return _models.get((_app(spark), key), build)
