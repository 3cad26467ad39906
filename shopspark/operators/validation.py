"""Row rules with reasons: findings as arrays, statuses as columns, quarantine splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Rule = tuple[str, Column]  # code, condition under which it is broken


def findings(*rules: Rule) -> Column:
    """Codes of the broken rules, in order; a NULL condition breaks nothing."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))


def first_reason(*rules: Rule) -> Column:
    return F.coalesce(*[F.when(broken, F.lit(code)) for code, broken in rules])


def validated(df: DataFrame, errors: list[Rule], warnings: list[Rule] = ()) -> DataFrame:
    """df with errors, warnings (arrays of codes) and is_valid."""
    df = df.withColumn("errors", findings(*errors)).withColumn("warnings", findings(*warnings) if warnings else F.array().cast("array<string>"))
    return df.withColumn("is_valid", F.size("errors") == 0)


def machine_record_rules(sep: str = ";") -> tuple[list[Rule], list[Rule]]:
    """(errors, warnings): the 26 rules of a machine record, over its columns. A value that isn't given breaks no rule about values."""
    c = F.col
    blank = lambda x: F.coalesce(F.trim(c(x)) == "", F.lit(True))
    bad = lambda *xs: F.exists(F.array(*[c(x) <= 0 for x in xs]), lambda b: F.coalesce(b, F.lit(False)))
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    processes = F.filter(F.split(F.coalesce("processes", F.lit("")), sep), lambda x: F.trim(x) != "")
    errors = [
        ("V-01", blank("stable_id") | c("stable_id").rlike(r"\s")), *[(f"V-{n:02}", blank(x)) for n, x in ((2, "manufacturer"), (3, "model"), (4, "machine_type"), (5, "machine_type_code"))], ("V-06", F.size(processes) == 0),
        ("V-07", c("axis_count").isNull() | bad("axis_count")), ("V-08", ~(yes("turning_capable") | yes("milling_capable") | yes("drilling_capable"))), ("V-09", blank("source_title")), ("V-10", blank("evidence_status")), ("V-11", bad("spindle_max_rpm")),
        ("V-12", bad("spindle_min_rpm") | (c("spindle_min_rpm") >= c("spindle_max_rpm"))), ("V-13", bad("spindle_power_kw")), ("V-14", bad("spindle_torque_nm")), ("V-15", bad("travel_x_mm", "travel_y_mm", "travel_z_mm")), ("V-16", bad("table_length_mm", "table_width_mm")),
        ("V-17", bad("table_load_kg")), ("V-20", bad("tool_magazine_capacity")), ("V-21", bad("rapid_traverse_mpm")), ("V-22", bad("simultaneous_axis_count") | (c("simultaneous_axis_count") > c("axis_count"))),
    ]
    warnings = [
        ("V-18", ~yes("turning_capable") & (c("max_turning_diameter_mm").isNotNull() | c("max_turning_length_mm").isNotNull())), ("V-19", ~yes("turning_capable") & c("bar_capacity_mm").isNotNull()),
        ("V-23", yes("capable_5axis_simultaneous") & ~c("simultaneous_axis_count").eqNullSafe(F.lit(5))), ("V-24", (c("machine_type_code") == "LATHE_Y") & ~yes("has_y_axis")), ("V-25", c("spindle_max_rpm").isNull()), ("V-26", c("spindle_power_kw").isNull()),
    ]
    return errors, warnings


def limit_status(requested: Column, limit: Column) -> Column:
    """PASS, FAIL, or INSUFFICIENT_DATA where either is unknown."""
    return F.when(requested.isNull() | limit.isNull(), "INSUFFICIENT_DATA").when(requested > limit, "FAIL").otherwise("PASS")


def utilisation(requested: Column, limit: Column) -> Column:
    return F.round(F.try_divide(requested.cast("double"), limit), 4)


def tolerance_status(value: Column, expected: Column, tolerance: float = 0.001) -> Column:
    return F.when(value.isNull() | expected.isNull(), "INSUFFICIENT_DATA").when(F.abs(value - expected) <= tolerance, "PASS").otherwise("FAIL")


def import_rows(batch: DataFrame, key: str, order: list[str], existing: DataFrame, duplicate_wins: bool, invalid_reserves: bool) -> DataFrame:
    """Outcome of an import of validated rows (is_valid): ACCEPTED, DUPLICATE or INVALID.

    A key repeats if it is in ``existing`` or an earlier row of the batch reserved it. Valid rows reserve their key, invalid ones
    where invalid_reserves says so. Where a row is both, duplicate_wins decides. Rows without a key can't repeat.
    """
    batch = batch.join(existing.select(F.col(key).alias("_had")).distinct(), batch[key] == F.col("_had"), "left")
    reserves = F.lit(True) if invalid_reserves else F.col("is_valid")
    earlier = F.sum(reserves.cast("int")).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    again = F.col(key).isNotNull() & (F.col("_had").isNotNull() | (F.coalesce(earlier, F.lit(0)) > 0))
    outcome = F.when(again & (F.col("is_valid") | F.lit(duplicate_wins)), "DUPLICATE").when(~F.col("is_valid"), "INVALID").otherwise("ACCEPTED")
    return batch.withColumn("outcome", outcome).drop("_had")


def refuse_repeated(df: DataFrame, *key: str) -> DataFrame:
    """Rows whose key stands more than once, with the number of them."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return df.join(counts, list(key))


def worst(status: Column, order: list[str]) -> Column:
    """Aggregate: the worst status of a group, order from best to worst; an empty group is INCOMPLETE."""
    rank = F.coalesce(*[F.when(status == s, F.lit(i)) for i, s in enumerate(order)])
    return F.coalesce(F.get(F.array(*map(F.lit, order)), F.max(rank)), F.lit("INCOMPLETE"))
