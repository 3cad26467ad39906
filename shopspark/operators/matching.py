"""Matching of findings with expected items, and text normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .drawing import unit_name
from .graph import _cut


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


#: Kinds of items that a value and a unit say enough about.
DIMENSIONS = ["LINEAR_DIMENSION", "DIAMETER", "RADIUS", "ANGLE", "TOLERANCE", "HOLE_CALLOUT"]


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def match_levels(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(run_id, fixture, finding_no, item_id, level): what may match within a fixture, at its best level.

    1 EXACT: equal texts without outer blanks; 2 NORMALISED: equal normal forms; 3 SEMANTIC: a dimension of equal value and unit (no unit
    on both sides is equal as well). found: run_id, fixture, finding_no, raw_text, value, unit; truth: fixture, item_id, expected_text,
    feature_type, value, unit.
    """
    keys = ["run_id", "fixture", "finding_no", "item_id"]
    f = found.select("run_id", "fixture", "finding_no", bare(F.col("raw_text")).alias("_raw"), normal(F.col("raw_text")).alias("_n"), bare(F.col("value")).alias("_v"), F.coalesce(unit_name(F.col("unit")), F.lit("")).alias("_u"))
    t = truth.select("fixture", "item_id", "feature_type", bare(F.col("expected_text")).alias("_want"), normal(F.col("expected_text")).alias("_n"), bare(F.col("value")).alias("_v"), F.coalesce(unit_name(F.col("unit")), F.lit("")).alias("_u"))
    text = f.join(t.select("fixture", "item_id", "_want", "_n"), ["fixture", "_n"]).select(*keys, F.when(F.col("_raw") == F.col("_want"), 1).otherwise(2).alias("level"))
    value = f.join(t.filter(F.col("feature_type").isin(DIMENSIONS)).select("fixture", "item_id", "_v", "_u"), ["fixture", "_v", "_u"]).select(*keys, F.lit(3).alias("level"))
    return text.unionByName(value).groupBy(*keys).agg(F.min("level").alias("level"))


def greedy(matches: DataFrame) -> DataFrame:
    """One-to-one matches: each finding, in order of finding_no, takes its best item (level, then item_id) that is left.

    In rounds without an order: every finding asks for its best item, an item is held by the first of those that ask, and every later
    finding gives it up. An item only ever passes to an earlier finding, so what is given up is never wanted back, and when nothing is
    given up any more, the holders are those of the order.
    """
    keys = ["run_id", "fixture"]
    left = _cut(matches)
    while True:
        asked = left.groupBy(*keys, "finding_no").agg(F.min(F.struct("level", "item_id")).alias("best"))
        held = asked.groupBy(*keys, F.col("best.item_id").alias("item_id")).agg(F.min("finding_no").alias("_holder"))
        marked = _cut(left.join(held, [*keys, "item_id"], "left").withColumn("_gone", F.coalesce(F.col("finding_no") > F.col("_holder"), F.lit(False))))
        left = marked.filter("NOT _gone").select(*keys, "finding_no", "item_id", "level")
        if marked.filter("_gone").isEmpty():
            best = left.groupBy(*keys, "finding_no").agg(F.min(F.struct("level", "item_id")).alias("b"))
            return best.select(*keys, "finding_no", "b.item_id", "b.level")


def score(found: DataFrame, truth: DataFrame, matched: DataFrame) -> DataFrame:
    """True and false positives, misses, missed required items, precision and recall per run."""
    runs = found.select("run_id").distinct()
    expected = runs.join(truth.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("required").alias("n_required")), how="cross")
    n_found = found.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_found"))
    hit = matched.join(truth.select("item_id", "required"), "item_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("tp"), F.count_if("required").alias("tp_required"), F.count_if(F.col("level") == 1).alias("n_exact"))
    d = expected.join(n_found, "run_id", "left").join(hit, "run_id", "left").na.fill(0)
    return d.select("run_id", "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_items") - F.col("tp")).alias("fn"), (F.col("n_required") - F.col("tp_required")).alias("critical_missed"), "n_exact", F.round(F.try_divide("tp", "n_found"), 6).alias("precision"), F.round(F.try_divide("tp", "n_items"), 6).alias("recall"))
