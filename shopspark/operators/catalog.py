"""Catalog filters, searches, lookups and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import wildcard

#: What may carry authority.
AUTHORITATIVE_STATUS = ["VERIFIED", "REFERENCE"]
NO_AUTHORITY = ["AI", "UNKNOWN"]


def items(listed: Column, sep: str = ";") -> Column:
    """The trimmed, non-empty entries of a separated list."""
    return F.filter(F.transform(F.split(listed, f"\\Q{sep}\\E"), lambda x: F.trim(x)), lambda x: x != "")


def filter_equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Case-insensitive equality on each given column; None asks for nothing. NULL cells never match."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.lower(F.col(name).cast("string")) == str(value).lower())
    return df


def filter_member(df: DataFrame, column: str, value: str | None, sep: str = ";") -> DataFrame:
    """Rows whose separated list has the value, ignoring case."""
    return df if value is None else df.filter(F.exists(items(F.col(column), sep), lambda x: F.lower(x) == value.lower()))


def filter_least(df: DataFrame, **least: float | None) -> DataFrame:
    """column >= minimum; a missing limit is not unlimited, so NULL rows go."""
    for name, value in least.items():
        if value is not None:
            df = df.filter(F.col(name) >= value)
    return df


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns contains the text, ignoring case."""
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False)) for c in columns]))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def in_scope(params: DataFrame, **scope: str | None) -> DataFrame:
    """Reference records for a scope; NULL in a record, or None asked, matches anything."""
    return params.filter(reduce(lambda a, b: a & b, [wildcard(F.col(k), F.lit(v).cast("string")) for k, v in scope.items()], F.lit(True)))


def is_usable_for_authority(status: Column, reference: Column, source_type: Column) -> Column:
    return F.coalesce(status.isin(AUTHORITATIVE_STATUS) & (F.length(F.trim(reference)) > 0) & ~source_type.isin(NO_AUTHORITY), F.lit(False))


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, and per column the number of distinct values and their sorted list."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[x for c in columns for x in (F.count_distinct(c).alias(f"n_{c}"), F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias(f"{c}_values"))])


def facets(df: DataFrame, listed: str, sep: str = ";") -> DataFrame:
    """Distinct entries of a list column with the number of rows that have them."""
    return df.select(F.explode(F.array_distinct(items(F.col(listed), sep))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def first_of_each(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; min_by aggregates on the map side, so a hot key costs nothing."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
