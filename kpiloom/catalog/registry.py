"""Registration of named queries and the frames they share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import cached_property, lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.catalog.definitions import with_definitions
from kpiloom.plans.star import build_star
from kpiloom.schemas import TABLES
from kpiloom.session import shared_dir, ship_package
from kpiloom.sources import versions
from kpiloom.sources.extracts import TimedCache
from kpiloom.sources.sinks import attach_star
from kpiloom.sources.standins import GIVEN_TABLES, RAW_TABLES, given, raw_frames


@lru_cache(maxsize=1)
def _code_mark() -> str:
    """What changes when the code that makes the star does."""
    package = Path(__file__).resolve().parent.parent
    parts = [package / "schemas.py", *(package / d for d in ("plans", "operators", "functions", "sources"))]
    files = sorted(f for p in parts for f in ([p] if p.is_file() else p.rglob("*.py")))
    return hashlib.sha256(b"\0".join(f.read_bytes() for f in files)).hexdigest()


class StoredStar(Mapping[str, DataFrame]):
    """The tables of a workspace's star, each loaded when it is first asked for."""

    def __init__(self, ws: Workspace):
        self._ws = ws
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name not in self._read:
            self._ws.attach([name])
            self._read[name] = versions.read(self._ws.spark, f"{self._ws.root}/{name}")
        return self._read[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


class Workspace:
    """Lazy raw and star frames over one directory of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return given(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return raw_frames(self.spark, self.sf_dir)

    @cached_property
    def built(self) -> dict[str, DataFrame]:
        """The star as lazy plans over the raw frames; employees carry no serial id yet."""
        return build_star(self.spark, self.raw)

    @cached_property
    def root(self) -> str:
        """Where the star is in the shared folder."""
        name = hashlib.sha256(self.sf_dir.encode()).hexdigest()[:16]
        return f"{shared_dir(self.spark).rstrip('/')}/kpiloom/star-{name}"

    def attach(self, tables: Iterable[str] = tuple(TABLES)) -> dict[str, int]:
        """Row counts of the star's tables, and of those they look keys up in, in the shared folder.

        Tables that another application loaded from the same files with the same code are
        attached; only those that are missing or stale are loaded.
        """
        counts, _loaded = attach_star(self.spark, self.raw, self.root, self.marks, _code_mark(), tables=tables)
        return counts

    @cached_property
    def stored(self) -> tuple[str, dict[str, int]]:
        """The whole star in the shared folder: root path and row counts."""
        return self.root, self.attach()

    @cached_property
    def marks(self) -> dict[str, str]:
        """A mark of each raw frame, from the given files it is made of."""
        each = {t: versions.source_mark(self.spark, [f"{self.sf_dir}/{t}.parquet"]) for t in GIVEN_TABLES}
        return {frame: "\n".join(each[t] for t in tables) for frame, tables in RAW_TABLES.items()}

    @cached_property
    def star(self) -> Mapping[str, DataFrame]:
        """The loaded star: KPI queries and models scan these tables."""
        return StoredStar(self)


# A workspace lives as long as the application: its star is a loaded warehouse.
_workspaces = TimedCache(ttl=float("inf"))
_queries: dict[str, Callable[[Workspace], DataFrame]] = {}
_sql: dict[str, str] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    ship_package(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    return _workspaces.get(key, lambda: Workspace(spark, sf_dir))


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its definition over the star tables."""

    def add(build: Callable[[Workspace], DataFrame]):
        if name in _queries:
            raise ValueError(f"duplicate query name: {name}")
        _queries[name] = build
        if sql is not None:
            _sql[name] = with_definitions(sql)
        return build

    return add


def plain_types(df: DataFrame) -> DataFrame:
    """Exact decimals become DOUBLE at the very end, for comparison only."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: plain_types(build(workspace(spark, sf_dir)))

    return {name: bind(build) for name, build in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
