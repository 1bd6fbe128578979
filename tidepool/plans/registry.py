"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import discard, park
from .views import bound, ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The same queries as functions of Tables.
OVER: dict[str, Callable[[Tables], DataFrame]] = {}


class Tables:
    """Tables and domain views of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step that queries have in common."""
        return make()


class Kept(Tables):
    """Tables for many queries at a time: the views and steps that they have in common are written when first asked for."""

    VIEWS = ("v_trades", "v_holders", "v_launches", "v_social")

    def __init__(self, t: Tables):
        super().__init__(t.spark, t.sf_dir)
        self._kept: dict[str, DataFrame] = {}
        self._locks: defaultdict[str, Lock] = defaultdict(Lock)

    def __call__(self, name: str) -> DataFrame:
        own = super().__call__
        return self.once(name, lambda: own(name)) if name in self.VIEWS else own(name)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._locks[name]:
            if name not in self._kept:
                self._kept[name] = park(make())
            return self._kept[name]

    def discard(self, *but: str) -> None:
        discard(*(self._kept.pop(name) for name in set(self._kept) - set(but)))


class Written(Tables):
    """Tables for a query that reads a view several times: the named ones are written when first asked for, with the columns it needs.

    Each reading would join the trades anew: columns are pruned apart, so the engine doesn't see that the shuffles are the same.
    """

    ROWS = 1 << 18  # of a file; a task then reads some five million, however narrow

    def __init__(self, t: Tables, **columns: str):
        super().__init__(t.spark, t.sf_dir)
        self._columns, self._written = columns, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._columns:
            return super().__call__(name)
        if name not in self._written:
            self._written[name] = park(super().__call__(name).select(*self._columns[name].split()), self.ROWS)
        return self._written[name]


def written(t: Tables, **columns: str) -> Tables:
    """``Written`` of views and their columns; tables that keep views themselves stay as they are."""
    return t if isinstance(t, Kept | Written) else Written(t, **columns)


def plan(name: str, sql: str, *views: str, own: Callable[[Tables], DataFrame] | None = None) -> None:
    """Registers one SQL text over the views, written in the part of SQL that both engines share; where they part, Spark runs ``own``."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    OVER[name] = own or (lambda t: bound(t.spark, t.sf_dir, sql, t))
    QUERIES[name] = lambda spark, sf_dir: OVER[name](Tables(spark, sf_dir))
    text = sql.strip()
    ORACLES[name] = f"WITH {ctes(*views)}, {text[4:].lstrip()}" if views and text.upper().startswith("WITH") else f"WITH {ctes(*views)} {text}" if views else text


def key(oracle: str | None = None, *views: str, name: str | None = None):
    """Registers fn(tables) as a query; ``oracle`` goes on from the views' CTEs."""

    def add(fn):
        own = name or fn.__name__
        if own in QUERIES:
            raise ValueError(f"query {own} is registered twice")
        OVER[own] = fn
        QUERIES[own] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            text = oracle.strip()
            if views:
                text = f"WITH {ctes(*views)}{'' if text.startswith(',') else ' '}{text}"
            ORACLES[own] = text
        return fn

    return add
