"""Guards: a formula with a missing or unfit input gives NULL and says why."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formula:
    """expr over named inputs; the inputs named in positive must be > 0, those in whole must be integral, others >= 0 unless in free."""

    inputs: tuple[str, ...]
    expr: Callable[..., Column]
    positive: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()
    free: tuple[str, ...] = ()
    #: Further conditions: reason -> condition over the inputs that must hold.
    require: tuple[tuple[str, Callable[..., Column]], ...] = ()

    def reason(self, **cols: Column) -> Column:
        """The first thing wrong with the inputs, in the order of the inputs; NULL if nothing is."""
        found = [F.when(cols[n].isNull() | F.isnan(cols[n].cast("double")), F.lit(f"MISSING_{n}".upper())) for n in self.inputs]
        for n in self.inputs:
            if n in self.positive:
                found.append(F.when(cols[n] <= 0, F.lit(f"NOT_POSITIVE_{n}".upper())))
            elif n not in self.free:
                found.append(F.when(cols[n] < 0, F.lit(f"NEGATIVE_{n}".upper())))
            if n in self.whole:
                found.append(F.when(cols[n] != F.floor(cols[n]), F.lit(f"NOT_WHOLE_{n}".upper())))
        found += [F.when(~ok(**cols), F.lit(why)) for why, ok in self.require]
        return F.coalesce(*found)

    def value(self, **cols: Column) -> Column:
        c = {n: cols[n].cast("double") for n in self.inputs}
        return F.when(self.reason(**cols).isNull(), self.expr(**c))

    def __call__(self, **cols: Column) -> Column:
        """struct(value, reason)."""
        return F.struct(self.value(**cols).alias("value"), self.reason(**cols).alias("reason"))


def missing_inputs(**cols: Column) -> Column:
    """Names of the NULL columns."""
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in cols.items()]))


def in_range(value: Column, unit: Column, low: Column, high: Column, range_unit: Column) -> Column:
    """Containment in an inclusive range; NULL where the units differ."""
    return F.when(unit == range_unit, value.between(low, high))


def wildcard(a: Column, b: Column) -> Column:
    """Equality of scope keys in which NULL on either side matches."""
    return a.isNull() | b.isNull() | (a == b)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals share a point."""
    return (a_start < b_end) & (b_start < a_end)
