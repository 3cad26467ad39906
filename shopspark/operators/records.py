"""Rules over the records of a shop: materials, experiments, tolerance frames, plan steps and plan documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .validation import Rule, findings, first_reason

c = F.col

#: ISO groups, subgroups of group S, hardness scales, plausible limits.
ISO_GROUPS = ["P", "M", "K", "N", "S", "H"]
S_SUBGROUPS = ["S_TITANIUM", "S_NICKEL_HRSA"]
HARDNESS_SCALES = ["HB", "HRC", "HRB", "HV"]
MOST_TENSILE_MPA, DENSITY_KG_M3 = 3500, (1500, 22000)

#: Geometric characteristics by what they may refer to.
FORM_ONLY = ["STRAIGHTNESS", "FLATNESS", "CIRCULARITY", "CYLINDRICITY"]
NEEDS_DATUM = ["PERPENDICULARITY", "PARALLELISM", "ANGULARITY", "POSITION", "CONCENTRICITY", "SYMMETRY", "CIRCULAR_RUNOUT", "TOTAL_RUNOUT"]
LEGACY = ["CONCENTRICITY", "SYMMETRY"]


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x.cast("string")) == "")


def material_issues() -> Column:
    """Codes over material_id, designation, iso_group, iso_subgroup, family, density, modulus, hardness_*, tensile, vc_min, vc_max.

    A zero stands for a missing value and is refused. A missing optional value breaks nothing.
    """
    rules: list[Rule] = [(f"REQUIRED_{n}".upper(), _blank(c(n))) for n in ("material_id", "designation", "iso_group", "iso_subgroup", "family")]
    rules += [
        ("INVALID_ISO_GROUP", ~c("iso_group").isin(ISO_GROUPS)),
        ("S_GROUP_NOT_DIFFERENTIATED", (c("iso_group") == "S") & ~F.coalesce(c("iso_subgroup"), F.lit("")).isin(S_SUBGROUPS)),
        ("ZERO_FOR_MISSING_DENSITY", c("density") == 0), ("ZERO_FOR_MISSING_MODULUS", c("modulus") == 0),
        ("INVALID_HARDNESS_SCALE", ~F.coalesce(c("hardness_scale"), F.lit("")).isin(HARDNESS_SCALES)),
        ("NON_POSITIVE_HARDNESS", (c("hardness_min") <= 0) | (c("hardness_max") <= 0)), ("HARDNESS_RANGE_INVERTED", c("hardness_min") > c("hardness_max")),
        ("NON_POSITIVE_VC", (c("vc_min") <= 0) | (c("vc_max") <= 0)),
        ("IMPLAUSIBLE_TENSILE", c("tensile") > MOST_TENSILE_MPA), ("IMPLAUSIBLE_DENSITY", ~c("density").between(*DENSITY_KG_M3)),
    ]
    return findings(*rules)


def _integer(name: str, least: int) -> list[Rule]:
    x = c(name).try_cast("int")
    return [(f"{name}_NOT_INTEGER".upper(), x.isNull()), (f"{name}_BELOW_{least}".upper(), x < least)]


def _positive(name: str) -> list[Rule]:
    x = c(name).try_cast("double")
    return [(f"{name}_NOT_NUMBER".upper(), x.isNull() | F.isnan(x)), (f"{name}_NOT_POSITIVE".upper(), x <= 0)]


def life_test_reason(sensors: list[str]) -> Column:
    """Why a raw tool-life row (all strings) is refused: the first of its checks that fails; NULL for a good row."""
    share = c("countdown_share").try_cast("double")
    rules = [*_integer("tool_index", 1), ("TOOL_TYPE_MISSING", c("tool_type").isNull()), ("TOOL_TYPE_UNKNOWN", ~F.trim("tool_type").isin("1", "2"))]
    for name in ("adoc", "rdoc", "hardness", "holder_length"):
        rules += _positive(name)
    rules += [*_integer("cycle", 1), *_integer("sample", 0), *_integer("countdown", 0)]
    rules += [("COUNTDOWN_SHARE_NOT_NUMBER", share.isNull()), ("COUNTDOWN_SHARE_OUTSIDE_0_1", ~share.between(0, 1))]
    for name in sensors:
        rules += [(f"{name}_MISSING".upper(), c(name).isNull()), (f"{name}_NOT_NUMBER".upper(), c(name).try_cast("double").isNull())]
    return first_reason(*rules)


def wear_test_reason(conditions: list[str], coatings: list[str], numbers: list[str]) -> Column:
    """Why a raw wear-test row is refused: categories as they are written, a replicate from 1 on, positive numbers."""
    rules = [("TOOL_CONDITION", c("tool_condition").isNull() | ~c("tool_condition").isin(conditions)), ("COATING", c("coating").isNull() | ~c("coating").isin(coatings)), *_integer("replicate", 1)]
    for name in numbers:
        rules += _positive(name)
    return first_reason(*rules)


def frame_findings(frames: DataFrame) -> DataFrame:
    """(drawing_id, frame_id, line_no, rule_id, severity) per broken rule of a tolerance frame (characteristic, modifier, datums, true_fos, tolerance, lower_tolerance)."""
    form, modified = c("characteristic").isin(FORM_ONLY), c("modifier").isin("MMC", "LMC")
    no_datum = c("datums").isNull()
    rules = [
        ("VAL-GDT-001", "ERROR", form & ~no_datum), ("VAL-GDT-002", "WARNING", c("characteristic").isin(NEEDS_DATUM) & no_datum),
        ("VAL-GDT-003", "ERROR", modified & ~F.coalesce(c("true_fos"), F.lit(False))), ("VAL-GDT-004", "ERROR", form & modified),
        ("VAL-GDT-006", "ERROR", c("lower_tolerance") > c("tolerance")), ("VAL-GDT-007", "WARNING", (c("characteristic") == "TOTAL_RUNOUT") & no_datum),
        ("VAL-GDT-008", "INFO", c("characteristic").isin(LEGACY)),
    ]
    hits = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, broken in rules]))
    return frames.select("drawing_id", "frame_id", "line_no", F.explode(hits).alias("f")).select("drawing_id", "frame_id", "line_no", "f.*")


def step_findings(steps: DataFrame) -> DataFrame:
    """(plan_id, rule_id, step_id, detail) of broken plan-step rules.

    R-2801 repeated step id, R-2802 repeated sequence index, R-2803 predecessor unknown or the step itself, R-2805 missing assignments.
    """
    def again(key: str, rule: str, detail: Column) -> DataFrame:
        n = steps.groupBy("plan_id", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return n.select("plan_id", F.lit(rule).alias("rule_id"), c(key).cast("long").alias("step_id"), detail.alias("detail"))

    ids = steps.select("plan_id", c("step_id").alias("known")).distinct()
    p = steps.filter("predecessor IS NOT NULL").select("plan_id", "step_id", "predecessor")
    p = p.join(ids, (p["plan_id"] == ids["plan_id"]) & (p["predecessor"] == ids["known"]), "left").select(p["plan_id"], "step_id", "predecessor", "known")
    why = F.when(c("predecessor") == c("step_id"), "SELF").when(c("known").isNull(), "UNKNOWN")
    p = p.select("plan_id", F.lit("R-2803").alias("rule_id"), c("step_id").cast("long").alias("step_id"), why.alias("detail")).filter("detail IS NOT NULL")
    missing = findings(*[(n, c(n).isNull()) for n in ("feature_id", "operation", "tool_id", "machine_id")])
    m = steps.select("plan_id", F.lit("R-2805").alias("rule_id"), c("step_id").cast("long").alias("step_id"), F.array_join(missing, ",").alias("detail")).filter("detail <> ''")
    text = c("n").cast("string")
    return again("step_id", "R-2801", text).unionByName(again("sequence_index", "R-2802", text)).unionByName(p).unionByName(m)


def _machining(operation: str = "operation") -> Column:
    return ~F.contains(F.upper(F.coalesce(c(operation), F.lit(""))), F.lit("INSPECT"))


def _given(name: str) -> Column:
    """A speed or feed is given where it is known and not zero."""
    return F.coalesce(c(name), F.lit(0)) != 0


def open_items(steps: DataFrame, uninspected: DataFrame) -> DataFrame:
    """(plan_id, category, severity, related_id): what machining steps lack, and critical characteristics without inspection."""
    cases = [("MISSING_MACHINE", "REVIEW_REQUIRED", c("machine_id").isNull()), ("MISSING_TOOL", "REVIEW_REQUIRED", c("tool_id").isNull()), ("MISSING_PARAMETER", "ADVISORY", ~_given("vc") & ~_given("feed_rate"))]
    hits = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(k).alias("category"), F.lit(s).alias("severity"))) for k, s, on in cases]))
    own = steps.filter(_machining()).select("plan_id", c("step_id").cast("long").alias("related_id"), F.explode(hits).alias("i")).select("plan_id", "i.*", "related_id")
    lost = uninspected.select("plan_id", F.lit("MISSING_INSPECTION").alias("category"), F.lit("BLOCKING").alias("severity"), c("characteristic_id").alias("related_id"))
    return own.unionByName(lost)


def uninspected(characteristics: DataFrame, covered: DataFrame) -> DataFrame:
    """Characteristics (plan_id, characteristic_id, ...) without a covered inspection row."""
    return characteristics.join(covered.select("plan_id", "characteristic_id").distinct(), ["plan_id", "characteristic_id"], "left_anti")


def completeness(steps: DataFrame) -> DataFrame:
    """(plan_id, seven shares, completeness, band): the mean share of machining steps that have what they need."""
    share = lambda on: F.coalesce(F.avg(F.when(_machining(), on.cast("int"))), F.lit(0.0))
    parts = {
        "machine": share(c("machine_id").isNotNull()), "tool": share(c("tool_id").isNotNull()), "holder": F.coalesce(F.avg(F.when(_machining(), c("holder_id").isNotNull().cast("int"))), F.lit(1.0)),
        "parameter": share(_given("vc")), "cycle_time": share(c("timed")), "inspection": F.avg(c("covered").cast("int")), "requirement": F.lit(1.0),
    }
    out = steps.groupBy("plan_id").agg(*[v.alias(k) for k, v in parts.items()])
    mean = sum((c(k) for k in parts), F.lit(0.0)) / len(parts)
    return out.withColumn("completeness", mean).withColumn("band", band(c("completeness")))


def band(completeness: Column) -> Column:
    return F.when(completeness >= 0.95, "COMPLETE").when(completeness >= 0.80, "MOSTLY_COMPLETE").when(completeness >= 0.50, "PARTIALLY_COMPLETE").otherwise("INCOMPLETE")


def gate(blocking: Column, review: Column, band: Column, completeness: Column) -> Column:
    held = F.when(blocking > 0, "BLOCKED").when(band == "INCOMPLETE", "INCOMPLETE").when((review > 0) | (completeness < 0.80), "REVIEW_REQUIRED")
    return held.otherwise("READY_FOR_ENGINEERING_REVIEW")


def release_gate(plans: DataFrame, items: DataFrame) -> DataFrame:
    """plans (plan_id, completeness, band) with blocking, review and gate."""
    n = items.groupBy("plan_id").agg(F.count_if(c("severity") == "BLOCKING").alias("blocking"), F.count_if(c("severity") == "REVIEW_REQUIRED").alias("review"))
    out = plans.join(n, "plan_id", "left").na.fill(0, ["blocking", "review"])
    return out.withColumn("gate", gate(c("blocking"), c("review"), c("band"), c("completeness")))


def plan_findings(plans: DataFrame, items: DataFrame, steps: DataFrame) -> DataFrame:
    """(plan_id, code, severity, n) of plan documents (plan_id, completeness, gate, fingerprint): V-002 no operations, V-003 uninspected critical
    characteristics, V-004 blocking items, V-005 gate against completeness, V-006 low completeness, V-007 no fingerprint."""
    n_ops = steps.groupBy("plan_id").agg(F.count("operation").alias("n_ops"))
    n_items = items.groupBy("plan_id").agg(F.count_if(c("category") == "MISSING_INSPECTION").alias("lost"), F.count_if(c("severity") == "BLOCKING").alias("blocking_items"))
    d = plans.join(n_ops, "plan_id", "left").join(n_items, "plan_id", "left").na.fill(0, ["n_ops", "lost", "blocking_items"])
    one = F.lit(1).cast("long")
    cases = [
        ("V-002", "REVIEW_REQUIRED", F.when(c("n_ops") == 0, one)), ("V-003", "BLOCKING", F.when(c("lost") > 0, c("lost"))), ("V-004", "BLOCKING", F.when(c("blocking_items") > 0, c("blocking_items"))),
        ("V-005", "REVIEW_REQUIRED", F.when((c("gate") == "READY_FOR_ENGINEERING_REVIEW") & (c("completeness") < 0.5), one)), ("V-006", "ADVISORY", F.when(c("completeness") < 0.8, one)),
        ("V-007", "ADVISORY", F.when(_blank(c("fingerprint")), one)),
    ]
    hits = F.filter(F.array(*[F.struct(F.lit(k).alias("code"), F.lit(s).alias("severity"), x.cast("long").alias("n")) for k, s, x in cases]), lambda x: x["n"].isNotNull())
    return d.select("plan_id", F.explode(hits).alias("f")).select("plan_id", "f.*")


def used_resources(steps: DataFrame, resource: str) -> DataFrame:
    """(plan_id, <resource>, step_ids): each machine or tool of a plan with its steps in order."""
    own = steps.filter(c(resource).isNotNull())
    return own.groupBy("plan_id", resource).agg(F.array_join(F.transform(F.sort_array(F.collect_list("step_id")), lambda x: x.cast("string")), ",").alias("step_ids"))


def failure_hooks(steps: DataFrame, critical: DataFrame) -> DataFrame:
    """(plan_id, step_id, characteristic_id): critical characteristics of a step's feature or of none; two equi joins instead of one with OR."""
    s = steps.select("plan_id", "step_id", "feature_id")
    own = s.filter("feature_id IS NOT NULL").join(critical.filter("feature_id IS NOT NULL").select("plan_id", "feature_id", "characteristic_id"), ["plan_id", "feature_id"])
    whole = s.join(critical.filter("feature_id IS NULL").select("plan_id", "characteristic_id"), "plan_id")
    return own.select("plan_id", "step_id", "characteristic_id").unionByName(whole.select("plan_id", "step_id", "characteristic_id"))


def handoff(steps: DataFrame) -> DataFrame:
    """Rows for NC programming: machining steps in order."""
    return steps.filter(_machining()).select("plan_id", "step_id", "operation", "machine_id", "tool_id", F.row_number().over(W.partitionBy("plan_id").orderBy("step_id", "k", "s")).alias("position"))
