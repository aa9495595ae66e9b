"""Registry of the named queries with their SQL twins.

Each entry states its output columns once, e.g. ``"county:s date:d rain:f6"``;
the same casts and roundings are applied to the DataFrame and to the SQL text:
``s`` text, ``d`` day as text, ``t`` timestamp as text, ``fN`` double
rounded to N places, ``l`` long, ``i`` int, ``b`` boolean, ``a`` array of text
joined by ``|``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwatch.functions.numeric import half_up
from panelwatch.plans.oracle import r, with_ctes
from panelwatch.sources.standins import Standins


@dataclass
class Query:
    name: str
    build: Callable[[Standins], DataFrame]
    columns: list[tuple[str, str]]
    needs: list[str] = field(default_factory=list)
    sql: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Standins(spark, folder)).select(*[_spark(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        outer = ", ".join(_sql(n, k) for n, k in self.columns)
        return with_ctes(self.needs, f"SELECT {outer} FROM ({self.sql}) AS q", self.extra)


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, needs: str = "", sql: str | None = None, extra: dict[str, str] | None = None):
    """Register the decorated function under ``name``."""
    specs = [tuple(c.rsplit(":", 1)) for c in columns.split()]

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(name, fn, specs, needs.split(), sql, extra or {})
        return fn

    return add


def _spark(name: str, kind: str) -> Column:
    col = F.col(f"`{name}`")
    if kind.startswith("f"):
        return half_up(col.cast("double"), int(kind[1:])).alias(name)
    casts = {
        "s": lambda c: c.cast("string"), "d": lambda c: c.cast("date").cast("string"), "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "l": lambda c: c.cast("long"), "i": lambda c: c.cast("int"), "b": lambda c: c.cast("boolean"),
        "a": lambda c: F.array_join(c, "|"),
    }
    return casts[kind](col).alias(name)


def _sql(name: str, kind: str) -> str:
    col = f'q."{name}"'
    if kind.startswith("f"):
        return f"{r(col, int(kind[1:]))} AS \"{name}\""
    casts = {
        "s": "CAST({c} AS VARCHAR)", "d": "CAST(CAST({c} AS DATE) AS VARCHAR)", "t": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
        "l": "CAST({c} AS BIGINT)", "i": "CAST({c} AS INTEGER)", "b": "CAST({c} AS BOOLEAN)",
        "a": "array_to_string({c}, '|')",
    }
    return casts[kind].format(c=col) + f' AS "{name}"'
