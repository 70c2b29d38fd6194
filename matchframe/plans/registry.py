"""Registry of demonstration queries: each binds an operator to the given tables, with the same result as SQL.

``out`` names the result columns and how both engines present them, e.g. "match_id:l team:s share:d6":
l whole number, dN double rounded to N digits, s text, b boolean, t date.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.plans.views import SPARK_VIEWS, TABLES, VIEWS

_TYPES = {"l": "bigint", "s": "string", "b": "boolean", "t": "date"}


class Inputs:
    """The given tables and the views over them, for one session and folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        return self.sql(SPARK_VIEWS.get(name, VIEWS[name]))

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL over the given tables and ``frames``."""
        used = {t: self.table(t) for t in TABLES if t in _words(text)} | frames
        named = re.sub(r"\b(from|join) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text)
        return self.spark.sql(named, **used)


@dataclass
class Query:
    name: str
    item: str
    build: Callable[[Inputs], DataFrame]
    out: list[tuple[str, str]]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Inputs(spark, folder))
        return df.select(*[_shown(F.col(c), kind).alias(c) for c, kind in self.out])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        columns = ", ".join(f"{_shown_sql(c, kind)} AS {c}" for c, kind in self.out)
        return f"{_with(self.sql)}SELECT {columns} FROM (\n{self.sql.strip()}\n) result"


QUERIES: dict[str, Query] = {}


def query(name: str, item: str, out: str, sql: str | None = None):
    """Register a query for an inventory item."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        columns = [tuple(part.split(":")) for part in out.split()]
        QUERIES[name] = Query(name, item, build, columns, sql)
        return build

    return register


def _shown(c: Column, kind: str) -> Column:
    if kind.startswith("d"):
        value = F.round(c.cast("double"), int(kind[1:]))
        return F.when(value == 0, F.lit(0.0)).otherwise(value)
    return c.cast(_TYPES[kind])


def _shown_sql(c: str, kind: str) -> str:
    if kind.startswith("d"):
        value = f"round(CAST({c} AS DOUBLE), {kind[1:]})"
        return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END"
    return f"CAST({c} AS {'VARCHAR' if kind == 's' else _TYPES[kind].upper()})"


def _with(sql: str) -> str:
    """WITH clause of the views a text reads, directly or through other views."""
    words = set(_words(sql))
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in VIEWS:
            if other != name and other in _words(VIEWS[name]):
                add(other)
        needed.append(name)

    for name in VIEWS:
        if name in words:
            add(name)
    if not needed:
        return ""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed) + "\n"


def _words(sql: str) -> list[str]:
    return "".join(ch if ch.isalnum() or ch == "_" else " " for ch in sql).split()
