"""Tool life, roughness, capability and inspection aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tool_summary(obs: DataFrame) -> DataFrame:
    """Per tool: observations, countdown range, whether life ended, and attributes of the first row by cycle."""
    c = F.col
    return obs.groupBy("tool_index").agg(F.count(F.lit(1)).alias("n_obs"), F.min("countdown").alias("min_countdown"), F.max("countdown").alias("max_countdown"), F.bool_or(c("countdown") == 0).alias("has_end"), F.min_by("tool_type", "cycle").alias("tool_type"), F.min_by("adoc_mm", "cycle").alias("adoc_mm"))


def stage_roughness(readings: DataFrame) -> DataFrame:
    """Stage means in mm; Ra only where every reading has one. A stage is valid if all its readings are."""
    c = F.col
    scale = F.when(c("unit") == "um", F.lit(1e-3)).otherwise(1.0)
    r = readings.withColumns({"rq": c("rq") * scale, "ra": c("ra") * scale})
    return r.groupBy("replicate_id", "stage_id").agg(F.avg("rq").alias("rq_mm"), F.when(F.count("ra") == F.count(F.lit(1)), F.avg("ra")).alias("ra_mm"), F.bool_and(c("validity") == "VALID").alias("valid"), F.count(F.lit(1)).alias("n"))


def lifecycle_roughness(stages: DataFrame) -> DataFrame:
    """Mean of the valid stages' means (not of their readings)."""
    v = stages.filter("valid")
    return v.groupBy("replicate_id").agg(F.avg("rq_mm").alias("rq_mm"), F.when(F.count("ra_mm") == F.count(F.lit(1)), F.avg("ra_mm")).alias("ra_mm"), F.count(F.lit(1)).alias("n_stages"))


def criticality(char_type: Column, tolerance: Column, ra: Column) -> Column:
    return F.when((char_type == "GDT") | (tolerance <= 0.02), "CRITICAL").when((char_type == "THREAD") | (tolerance <= 0.1) | (ra <= 0.8), "MAJOR").otherwise("MINOR")


def gage(char_type: Column, tolerance: Column) -> Column:
    return (F.when(char_type == "THREAD", "THREAD_GAGE").when(char_type == "SURFACE_FINISH", "ROUGHNESS_TESTER").when(char_type == "GDT", "CMM").when(tolerance.isNull(), "UNRESOLVED").when(tolerance <= 0.02, "CMM").when(tolerance <= 0.1, "MICROMETER").otherwise("CALIPER"))


def frequency(level: Column) -> Column:
    return F.when(level == "CRITICAL", "EVERY_PART").when(level == "MAJOR", "1_IN_5").otherwise("1_IN_20")


def inspection_plan(chars: DataFrame) -> DataFrame:
    """Characteristics with tolerance width, criticality, gage, frequency and reaction."""
    c = F.col
    width = c("upper_tol") - c("lower_tol")
    d = chars.withColumn("width", width).withColumn("level", criticality(c("char_type"), c("width"), c("ra_um"))).withColumn("gage", gage(c("char_type"), c("width")))
    return d.withColumn("frequency", frequency(c("level"))).withColumn("reaction", F.when(c("level") == "CRITICAL", "STOP_AND_CONTAIN").otherwise("ADJUST_AND_RECHECK"))


def virtual_condition(is_hole: Column, size: Column, upper: Column, lower: Column, tolerance: Column, at_mmc: Column) -> Column:
    """struct(mmc, lmc, bonus, virtual): material limits, bonus at the actual size and virtual condition; NULL where a limit is unknown."""
    mmc = F.when(is_hole, size + lower).otherwise(size + upper)
    lmc = F.when(is_hole, size + upper).otherwise(size + lower)
    bonus = F.when(at_mmc, F.greatest(F.lit(0.0), F.abs(size - mmc))).otherwise(F.lit(0.0))
    return F.struct(mmc.alias("mmc"), lmc.alias("lmc"), bonus.alias("bonus"), F.when(is_hole, mmc - tolerance).otherwise(mmc + tolerance).alias("virtual"))


def hole_patterns(features: DataFrame) -> DataFrame:
    """Groups of holes of a part with one rounded diameter: centroid, spread of the radii, and whether they lie on a circle (spread under 10 %)."""
    c = F.col
    h = features.filter("feature_type = 'HOLE'").withColumn("d", F.round(c("d_mm"), 1))
    g = h.groupBy("part_id", "d").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).filter("n >= 2")
    r = h.join(g, ["part_id", "d"]).withColumn("r", F.hypot(c("x") - c("cx"), c("y") - c("cy")))
    out = r.groupBy("part_id", "d").agg(F.first("n").alias("n"), F.avg("r").alias("radius"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    return out.withColumn("circular", (c("n") >= 3) & (c("radius") > 0) & (F.try_divide(c("hi") - c("lo"), c("radius")) < 0.1))


def pattern_types(features: DataFrame) -> DataFrame:
    """(part_id, d, n, kind, pcd_mm, pitch_deg, pitch_mm) of the holes of a part with one rounded diameter, two at least.

    CIRCULAR: three and more whose distance from their centre is over 0.5 mm and varies by less than a tenth. LINEAR: over 0.5 mm long,
    off their principal direction by at most a hundredth of the length, and with gaps along it that vary by less than a tenth of the
    pitch. The direction comes from the group's second moments, the gaps from the order along it. Others are NONE.
    """
    c = F.col
    key = ["part_id", "d"]
    h = features.filter("feature_type = 'HOLE'").select("part_id", F.round("d_mm", 1).alias("d"), c("x"), c("y")).dropna()
    g = W.partitionBy(*key)
    h = h.withColumns({"n": F.count(F.lit(1)).over(g), "dx": c("x") - F.avg("x").over(g), "dy": c("y") - F.avg("y").over(g)}).filter("n >= 2")
    h = h.withColumn("turn", 0.5 * F.atan2(2 * F.sum(c("dx") * c("dy")).over(g), F.sum(c("dx") * c("dx") - c("dy") * c("dy")).over(g)))
    h = h.withColumns({"along": c("dx") * F.cos("turn") + c("dy") * F.sin("turn"), "off": F.abs(c("dy") * F.cos("turn") - c("dx") * F.sin("turn")), "r": F.hypot("dx", "dy")})
    h = h.withColumn("gap", c("along") - F.lag("along").over(g.orderBy("along")))
    m = h.groupBy(*key).agg(F.first("n").alias("n"), F.avg("r").alias("r"), F.min("r").alias("r0"), F.max("r").alias("r1"), (F.max("along") - F.min("along")).alias("long"), F.max("off").alias("off"), F.min("gap").alias("g0"), F.max("gap").alias("g1"))
    pitch = c("long") / (c("n") - 1)
    circular = (c("n") >= 3) & (c("r") > 0.5) & (F.greatest(c("r1") - c("r"), c("r") - c("r0")) < 0.1 * c("r"))
    linear = (c("long") > 0.5) & (c("off") <= 0.01 * c("long")) & (F.greatest(c("g1") - pitch, pitch - c("g0")) < 0.1 * pitch)
    m = m.withColumn("kind", F.when(circular, "CIRCULAR").when(linear, "LINEAR").otherwise("NONE"))
    only = lambda k, v: F.when(c("kind") == k, F.round(v, 3))
    return m.select(*key, "n", "kind", only("CIRCULAR", 2 * c("r")).alias("pcd_mm"), only("CIRCULAR", 360 / c("n")).alias("pitch_deg"), only("LINEAR", pitch).alias("pitch_mm"))
