"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.views import VIEWS, Shop


@dataclass(frozen=True)
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def with_views(sql: str) -> str:
    """Prefix a query with the domain views it names, and those that they name."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):].lstrip()}"
    if re.match(r"WITH\s", body, re.I):
        return f"WITH {ctes}, {body[4:].lstrip()}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None):
    """Register a function of the shop's tables; sql may use the domain views."""

    def add(f: Callable[[Shop], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} exists")
        ENTRIES[name] = Entry(lambda spark, sf_dir: f(Shop(spark, sf_dir)), with_views(sql) if sql else None)
        return f

    return add


def r6(x: Column) -> Column:
    """Six digits; the small step off ties lets two engines round alike."""
    return F.round(x + F.lit(1e-9), 6)
