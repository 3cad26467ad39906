"""NC words, block classes and arc geometry as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"


def clean(text: Column) -> Column:
    """Upper case, without (comments) and what follows a semicolon."""
    plain = F.when(F.contains(text, F.lit("(")), F.regexp_replace(text, r"\([^)]*\)", " ")).otherwise(text)
    return F.upper(F.when(F.contains(plain, F.lit(";")), F.regexp_replace(plain, ";.*$", "")).otherwise(plain))


def word(block: Column, letter: str) -> Column:
    """Value of the last word with this letter; NULL without one. Only blocks that hold the letter are searched."""
    return F.when(F.contains(block, F.lit(letter)), F.try_element_at(F.regexp_extract_all(block, F.lit(letter + r"\s*" + NUMBER), F.lit(1)), F.lit(-1)).try_cast("double"))


def codes(block: Column, letter: str) -> Column:
    """All numbers of G or M words in tenths, so that G91.1 (911) isn't G91 (910)."""
    found = F.transform(F.regexp_extract_all(block, F.lit(letter + r"\s*" + NUMBER), F.lit(1)), lambda x: F.round(x.try_cast("double") * 10).cast("int"))
    return F.when(F.contains(block, F.lit(letter)), found).when(block.isNotNull(), F.array().cast("array<int>"))


def last_of(numbers: Column, *wanted: int) -> Column:
    """The last of the codes (in tenths) that is one of those wanted (whole)."""
    return F.try_element_at(F.filter(numbers, lambda x: x.isin(*[10 * w for w in wanted])), F.lit(-1)) / 10


def is_macro(text: Column) -> Column:
    return text.rlike(r"#|\b(IF|WHILE|GOTO)\b")


def block_class(text: Column) -> Column:
    """EMPTY, COMMENT, MACRO, TOOL, SPINDLE, MODAL, RAPID, CUT, MOVE or OTHER; the first that fits."""
    b = F.trim(clean(text))
    return (F.when(F.trim(text) == "", "EMPTY").when(b == "", "COMMENT").when(is_macro(text), "MACRO").when(b.rlike(r"\bT[0-9]|\bM0*6\b"), "TOOL").when(b.rlike(r"\bS[0-9]|\bM0*[345]\b"), "SPINDLE")
            .when(b.rlike(r"\bG0*0\b"), "RAPID").when(b.rlike(r"\bG0*[123]\b"), "CUT").when(b.rlike(r"\bG(17|18|19|20|21|90|91|94|95)\b"), "MODAL").when(b.rlike(r"[XYZ]"), "MOVE").otherwise("OTHER"))


def arc_sweep(a_start: Column, a_end: Column, clockwise: Column) -> Column:
    """Angle from start to end in the direction of travel, in (0, 2 pi]."""
    turn = F.pmod(F.when(clockwise, a_start - a_end).otherwise(a_end - a_start), F.lit(2 * math.pi))
    return F.when(turn <= 1e-12, F.lit(2 * math.pi)).otherwise(turn)


def arc_length(x0: Column, y0: Column, x1: Column, y1: Column, i: Column, j: Column, rise: Column, clockwise: Column) -> Column:
    """Length of a (helical) arc about (x0 + i, y0 + j); NULL where the radii of start and end differ by 1 um or more, or by 0.01 % or more."""
    r0, r1 = F.hypot(i, j), F.hypot(x1 - x0 - i, y1 - y0 - j)
    ok = (r0 > 0) & (F.abs(r0 - r1) < 1e-3) & (F.abs(r0 - r1) < 1e-4 * r0)
    sweep = arc_sweep(F.atan2(-j, -i), F.atan2(y1 - y0 - j, x1 - x0 - i), clockwise)
    return F.when(ok, F.hypot(r0 * sweep, rise))
