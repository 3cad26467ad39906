"""ISO tolerance widths and capability bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nominal size steps in mm (bounds inclusive, a shared bound belongs to the lower step).
SIZE_STEPS = [(1, 3), (3, 6), (6, 10), (10, 18), (18, 30), (30, 50), (50, 80), (80, 120), (120, 180), (180, 250), (250, 315), (315, 400), (400, 500)]
#: Tolerance units per grade.
GRADE_FACTORS = {1: 0.8, 2: 1.2, 3: 2.0, 4: 3.0, 5: 7.0, 6: 10.0, 7: 16.0, 8: 25.0, 9: 40.0, 10: 64.0, 11: 100.0, 12: 160.0, 13: 250.0, 14: 400.0, 15: 640.0, 16: 1000.0, 17: 1600.0, 18: 2500.0}


def it_tolerance_um(grade: Column, size_mm: Column) -> Column:
    """Tolerance width in micrometres: factor * (0.45 * cbrt(D) + 0.001 * D), D the geometric mean of the size step; NULL outside."""
    mean = F.coalesce(*[F.when(size_mm.between(lo, hi), F.lit((lo * hi) ** 0.5)) for lo, hi in SIZE_STEPS])
    factor = F.coalesce(*[F.when(grade == g, F.lit(m)) for g, m in GRADE_FACTORS.items()])
    return F.round(factor * (0.45 * F.pow(mean, F.lit(1 / 3)) + 0.001 * mean), 2)


def it_tolerance_range_um(grade_a: Column, grade_b: Column, size_mm: Column) -> Column:
    """struct(tightest, loosest); NULL if either is."""
    lo, hi = it_tolerance_um(F.least(grade_a, grade_b), size_mm), it_tolerance_um(F.greatest(grade_a, grade_b), size_mm)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("tightest"), hi.alias("loosest")))


def capability_band(required: Column, best: Column) -> Column:
    """Margin = required / best achievable: at least 2 comfortable, at least 1 capable, else not; NULL inputs are no pass."""
    margin = F.try_divide(required, best)
    return F.when(best.isNull(), "OUT_OF_RANGE").when(margin.isNull(), "INSUFFICIENT_DATA").when(required >= 2 * best, "COMFORTABLE").when(required >= best, "CAPABLE").otherwise("NOT_CAPABLE")


def surface_margin(required_ra: Column, best_ra: Column) -> Column:
    """Share by which the best achievable roughness undercuts the required one."""
    return F.try_divide(required_ra - best_ra, required_ra)
